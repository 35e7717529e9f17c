"""Reading the raw CSV files: null tokens, hard and soft casts, header variants, event time."""

from datetime import date, datetime

import pytest

from cohortrail.sources.raw_csv import RAW_TABLES, check_inputs, load

HEADERS = {
    "encounters": [
        "EncounterKey", "PatientDurableKey", "DepartmentKey", "ProviderDurableKey",
        "PrimaryDiagnosisKey", "Type", "VisitType", "VisitTypeDescription", "AdmissionType",
        "AdmissionSource", "AdmissionInstant", "DischargeInstant", "Date", "IsEdVisit",
        "IsHospitalAdmission", "IsHospitalOutpatientVisit", "IsInpatientAdmission",
        "IsObservation", "IsOutpatientFaceToFaceVisit", "AdmitYear",
    ],
    "patients": [
        "SexualOrientation", "DurableKey", "PatientBirthYearBin", "SexAssignedAtBirth", "FirstRace",
        "OmbRace", "OmbEthnicity", "MaritalStatus", "MyChartStatus", "SmokingStatus",
        "VitalStatus", "CensusBlockGroupFipsCode",
    ],
}


def write(tmp_path, name, lines):
    (tmp_path / RAW_TABLES[name].file).write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def patient_line(key="1", year="1970", sex="Male", fips="020130001"):
    return f"x,{key},{year},{sex},a,b,c,d,e,f,g,{fips}"


def load_patients(spark, tmp_path, *lines):
    src = write(tmp_path, "patients", [",".join(HEADERS["patients"]), *lines])
    return load(spark, src, "patients").collect()


def test_tokens_are_null_and_empty_text_stays(spark, tmp_path):
    rows = load_patients(
        spark, tmp_path,
        patient_line("1", fips="NA"), patient_line("2", fips="*Unspecified"),
        patient_line("3", sex="*Unknown", fips=""), patient_line("4", fips='""'),
    )
    assert [r.FipsCode for r in rows] == [None, None, "", ""]
    assert [r.SexAtBirth for r in rows] == ["Male", "Male", None, "Male"]


def test_kept_columns_are_found_by_name(spark, tmp_path):
    (row,) = load_patients(spark, tmp_path, patient_line())
    assert row.PatientDurableKey == 1
    assert row.VitalStatus == "g"
    assert not hasattr(row, "SexualOrientation")


def test_leading_zero_of_a_code_survives(spark, tmp_path):
    (row,) = load_patients(spark, tmp_path, patient_line(fips="020130001"))
    assert row.FipsCode == "020130001"


def test_soft_cast_gives_null_and_accepts_a_decimal_point(spark, tmp_path):
    rows = load_patients(
        spark, tmp_path, patient_line(year="abc"), patient_line(year="1970.0"), patient_line(year="")
    )
    assert [r.BirthYearBin for r in rows] == [None, 1970, None]


def test_bad_patient_key_fails_the_load(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_patients(spark, tmp_path, patient_line("abc"))


def test_tokens_stay_values_elsewhere(spark, tmp_path):
    src = write(
        tmp_path, "departments",
        ["DepartmentKey,Department Name,DepartmentSpecialty,DepartmentType,City,County,PostalCode,"
         "CensusTract,Address",
         '1,"Main, East",,*Unknown,NA,"",00123,045,x', "k,y,s,ED,c,c,1,2,z"],
    )
    first, second = load(spark, src, "departments").collect()
    assert first.DepartmentType == "*Unknown"
    assert first.City == "NA"
    assert first.DepartmentSpecialty is None
    assert first.County is None
    assert first.DepartmentName == "Main, East"
    assert (first.PostalCode, first.DeptCensusTract) == ("00123", "045")
    assert second.DepartmentKey is None


@pytest.mark.parametrize(("lon", "population"), [("CENTLON", "PopulationValue"), ("CENTLONG", "Population")])
def test_either_tiger_header(spark, tmp_path, lon, population):
    src = write(tmp_path, "tiger", [f"GEOID,CENTLAT,{lon},{population}", "0201,+39.5,-95.25,1200"])
    (row,) = load(spark, src, "tiger").collect()
    assert (row.FipsCode, row.lat, row.lon, row.Population) == ("0201", 39.5, -95.25, 1200)


def test_absent_column_is_named(spark, tmp_path):
    src = write(tmp_path, "tiger", ["GEOID,CENTLAT,Population", "1,2,3"])
    with pytest.raises(ValueError, match="CENTLON or CENTLONG"):
        load(spark, src, "tiger")


def encounter_line(key="1", admitted="", day="2022-03-05", ed="0"):
    return f"{key},2,3,4,5,Visit,a,b,c,d,{admitted},bad,{day},{ed},0,0,true,0,1,2022"


def load_encounters(spark, tmp_path, *lines):
    src = write(tmp_path, "encounters", [",".join(HEADERS["encounters"]), *lines])
    return load(spark, src, "encounters").collect()


def test_event_time_falls_back_to_midnight(spark, tmp_path):
    rows = load_encounters(
        spark, tmp_path,
        encounter_line(admitted="2022-03-04 13:45:10"), encounter_line(admitted="soon"),
        encounter_line(day="never"), encounter_line("x"),
    )
    assert [r.encounter_ts for r in rows] == [
        datetime(2022, 3, 4, 13, 45, 10), datetime(2022, 3, 5), None, datetime(2022, 3, 5),
    ]
    assert rows[0].EncounterDate == date(2022, 3, 5)
    assert rows[0].DischargeInstant is None
    assert rows[3].EncounterKey is None


def test_flags_are_numbers(spark, tmp_path):
    rows = load_encounters(spark, tmp_path, encounter_line(ed="1"), encounter_line(ed=""))
    assert [r.IsEdVisit for r in rows] == [1, None]
    assert rows[0].IsInpatientAdmission == 1


def test_bad_flag_fails_the_load(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_encounters(spark, tmp_path, encounter_line(ed="maybe"))


def test_line_break_inside_quotes(spark, tmp_path):
    src = write(
        tmp_path, "diagnosis",
        ["DiagnosisKey,DiagnosisValue,DiagnosisName,GroupCode,GroupName", '1,v,"a\nb ""c""",g,n'],
    )
    (row,) = load(spark, src, "diagnosis", multiline=True).collect()
    assert row.DiagnosisName == 'a\nb "c"'


def test_missing_files_are_listed(spark, tmp_path):
    write(tmp_path, "tiger", ["GEOID"])
    with pytest.raises(FileNotFoundError) as error:
        check_inputs(spark, str(tmp_path))
    assert "patients.csv" in str(error.value)
    assert "tigercensuscodes.csv" not in str(error.value)


def write_diagnosis(tmp_path, *lines, part=None):
    path = tmp_path / "diagnosis.csv"
    if part:
        path.mkdir(exist_ok=True)
        path = path / part
    path.write_text("\n".join(lines) + "\n")
    return str(tmp_path)


HEADER = "DiagnosisKey,DiagnosisValue,DiagnosisName,GroupCode,GroupName"


@pytest.mark.parametrize("record", ['1,a,"broken\nname",g,n', "1,a,short", "1,a,b,c,d,surplus"])
def test_broken_records_fail_the_load(spark, tmp_path, record):
    src = write_diagnosis(tmp_path, HEADER, record)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        load(spark, src, "diagnosis").collect()


def test_parts_with_other_headers_fail_the_load(spark, tmp_path):
    write_diagnosis(tmp_path, HEADER, "1,a,b,c,d", part="a.csv")
    src = write_diagnosis(tmp_path, HEADER, "2,a,b,c,d", part="b.csv")
    assert sorted(r.DiagnosisKey for r in load(spark, src, "diagnosis").collect()) == [1, 2]
    swapped = "DiagnosisValue,DiagnosisKey,DiagnosisName,GroupCode,GroupName"
    write_diagnosis(tmp_path, swapped, "x,3,b,c,d", part="c.csv")
    with pytest.raises(Exception, match="(?i)header"):
        load(spark, src, "diagnosis").collect()

"""Raw city tables: header names, and the name and type each column gets.

Everything is read as text and typed by one projection, so a bad value costs a cell, not a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudspark.functions.dates import compact_date, portal_date
from fraudspark.functions.numbers import to_number

CASTS = {
    "text": lambda c: c,
    "double": lambda c: to_number(c, "double"),
    "bigint": lambda c: to_number(c, "bigint"),
    "compact_date": compact_date,
    "portal_date": portal_date,
}

# Columns of the raw tables as (header, name, type).
DOB_VIOLATIONS = [
    ("BIN", "bin", "text"),
    ("BORO", "borough", "text"),
    ("BLOCK", "block", "text"),
    ("LOT", "lot", "text"),
    ("HOUSE_NUMBER", "house_number", "text"),
    ("STREET", "street", "text"),
    ("ISN_DOB_BIS_VIOL", "violation_id", "text"),
    ("VIOLATION_NUMBER", "violation_number", "text"),
    ("VIOLATION_CATEGORY", "violation_category", "text"),
    ("VIOLATION_TYPE", "violation_type", "text"),
    ("VIOLATION_TYPE_CODE", "violation_type_code", "text"),
    ("ISSUE_DATE", "issue_date", "compact_date"),
    ("DISPOSITION_DATE", "disposition_date", "compact_date"),
    ("DISPOSITION_COMMENTS", "disposition_comments", "text"),
    ("DEVICE_NUMBER", "device_number", "text"),
    ("DESCRIPTION", "description", "text"),
    ("ECB_NUMBER", "ecb_number", "text"),
    ("NUMBER", "number", "text"),
]

ECB_VIOLATIONS = [
    ("BIN", "bin", "text"),
    ("BORO", "borough", "text"),
    ("BLOCK", "block", "text"),
    ("LOT", "lot", "text"),
    ("ISN_DOB_BIS_EXTRACT", "violation_id", "text"),
    ("ECB_VIOLATION_NUMBER", "ecb_violation_number", "text"),
    ("ECB_VIOLATION_STATUS", "ecb_violation_status", "text"),
    ("DOB_VIOLATION_NUMBER", "dob_violation_number", "text"),
    ("ISSUE_DATE", "issue_date", "compact_date"),
    ("SERVED_DATE", "served_date", "compact_date"),
    ("HEARING_DATE", "hearing_date", "compact_date"),
    ("HEARING_TIME", "hearing_time", "text"),
    ("SEVERITY", "severity", "text"),
    ("VIOLATION_TYPE", "violation_type", "text"),
    ("VIOLATION_DESCRIPTION", "violation_description", "text"),
    ("PENALITY_IMPOSED", "penalty_imposed", "double"),
    ("AMOUNT_PAID", "amount_paid", "double"),
    ("BALANCE_DUE", "balance_due", "double"),
    ("HEARING_STATUS", "hearing_status", "text"),
    ("CERTIFICATION_STATUS", "certification_status", "text"),
    ("AGGRAVATED_LEVEL", "aggravated_level", "text"),
    ("RESPONDENT_NAME", "respondent_name", "text"),
    ("RESPONDENT_HOUSE_NUMBER", "respondent_house_number", "text"),
    ("RESPONDENT_STREET", "respondent_street", "text"),
    ("RESPONDENT_CITY", "respondent_city", "text"),
    ("RESPONDENT_ZIP", "respondent_zip", "text"),
]

JOB_FILINGS = [
    ("Bin #", "bin", "text"),
    ("House #", "house_number", "text"),
    ("Street Name", "street", "text"),
    ("Borough", "borough", "text"),
    ("Block", "block", "text"),
    ("Lot", "lot", "text"),
    ("Owner's Business Name", "owner_business_name", "text"),
    ("Owner's First Name", "owner_first_name", "text"),
    ("Owner's Last Name", "owner_last_name", "text"),
    ("Owner's House Number", "owner_house_number", "text"),
    ("Owner'sHouse Street Name", "owner_street", "text"),
    ("City ", "owner_city", "text"),
    ("State", "owner_state", "text"),
    ("Zip", "owner_zip", "text"),
    ("Owner'sPhone #", "owner_phone", "text"),
    ("Owner Type", "owner_type", "text"),
    ("Non-Profit", "non_profit", "text"),
    ("Job #", "job_number", "text"),
    ("Doc #", "doc_number", "text"),
    ("Job Type", "job_type", "text"),
    ("Job Status", "job_status", "text"),
    ("Job Status Descrp", "job_status_description", "text"),
    ("Building Type", "building_type", "text"),
    ("Community - Board", "community_board", "text"),
    ("Cluster", "cluster", "text"),
    ("Landmarked", "landmarked", "text"),
    ("Adult Estab", "adult_establishment", "text"),
    ("Loft Board", "loft_board", "text"),
    ("City Owned", "city_owned", "text"),
    ("Little e", "little_e", "text"),
    ("PC Filed", "pc_filed", "text"),
    ("eFiling Filed", "efiling_filed", "text"),
    ("Job Description", "job_description", "text"),
    ("Initial Cost", "initial_cost", "double"),
    ("Total Est. Fee", "total_estimated_fee", "double"),
    ("Fee Status", "fee_status", "text"),
    ("Existing Zoning Sqft", "existing_zoning_sqft", "double"),
    ("Proposed Zoning Sqft", "proposed_zoning_sqft", "double"),
    ("Existing Dwelling Units", "existing_dwelling_units", "bigint"),
    ("Proposed Dwelling Units", "proposed_dwelling_units", "bigint"),
    ("ExistingNo. of Stories", "existing_stories", "bigint"),
    ("Proposed No. of Stories", "proposed_stories", "bigint"),
    ("Existing Height", "existing_height", "double"),
    ("Proposed Height", "proposed_height", "double"),
    ("Zoning Dist1", "zoning_district_1", "text"),
    ("Zoning Dist2", "zoning_district_2", "text"),
    ("Zoning Dist3", "zoning_district_3", "text"),
    ("Special District 1", "special_district_1", "text"),
    ("Special District 2", "special_district_2", "text"),
    ("BUILDING_CLASS", "building_class", "text"),
    ("GIS_LATITUDE", "latitude", "double"),
    ("GIS_LONGITUDE", "longitude", "double"),
    ("GIS_COUNCIL_DISTRICT", "council_district", "text"),
    ("GIS_NTA_NAME", "nta_name", "text"),
    ("Applicant's First Name", "applicant_first_name", "text"),
    ("Applicant's Last Name", "applicant_last_name", "text"),
    ("Applicant Professional Title", "applicant_title", "text"),
    ("Applicant License #", "applicant_license", "text"),
    ("Professional Cert", "professional_cert", "text"),
]

HOUSING_LITIGATIONS = [
    ("LitigationID", "litigation_id", "text"),
    ("CaseType", "case_type", "text"),
    ("CaseStatus", "case_status", "text"),
    ("CaseOpenDate", "open_date", "text"),
    ("Respondent", "respondent", "text"),
    ("FindingOfHarassment", "finding_of_harassment", "text"),
    ("Penalty", "penalty", "text"),
    ("BIN", "bin", "text"),
    ("BBL", "bbl", "text"),
    ("HouseNumber", "house_number", "text"),
    ("StreetName", "street_name", "text"),
    ("Boro", "borough_code", "text"),
    ("Zip", "zip_code", "text"),
    ("Latitude", "latitude", "double"),
    ("Longitude", "longitude", "double"),
]

COMPLAINTS = [
    ("Complaint Number", "complaint_number", "text"),
    ("Status", "status", "text"),
    ("Complaint Category", "complaint_category", "text"),
    ("Unit", "unit", "text"),
    ("Disposition Code", "disposition_code", "text"),
    ("Date Entered", "date_entered", "text"),
    ("Disposition Date", "disposition_date", "text"),
    ("Inspection Date", "inspection_date", "text"),
    ("BIN", "bin", "text"),
    ("House Number", "house_number", "text"),
    ("House Street", "street_name", "text"),
    ("ZIP Code", "zip_code", "text"),
    ("Community Board", "community_board", "text"),
]

PERMITS = [
    ("Job #", "job_number", "text"),
    ("Job", "job", "text"),
    ("Permit Type", "permit_type", "text"),
    ("Job Type", "job_type", "text"),
    ("Work Type", "work_type", "text"),
    ("Current Status", "permit_status", "text"),
    ("Filing Date", "filing_date", "text"),
    ("Pre- Filing Date", "pre_filing_date", "text"),
    ("Issuance Date", "issue_date", "text"),
    ("Expiration Date", "expiration_date", "text"),
    ("Job Description", "job_description", "text"),
    ("BIN", "bin", "text"),
    ("BBL", "bbl", "text"),
    ("House #", "house_number", "text"),
    ("Street Name", "street_name", "text"),
    ("Borough", "borough_code", "text"),
    ("Zip Code", "zip_code", "text"),
    ("Owner's First Name", "owner_first_name", "text"),
    ("Owner's Last Name", "owner_last_name", "text"),
    ("Owner's Business Name", "owner_business_name", "text"),
    ("Owner's Phone #", "owner_phone", "text"),
    ("Owner's Business Type", "owner_business_type", "text"),
]

Spec = list[tuple[str, str, str]]


def raw_schema(spec: Spec) -> T.StructType:
    return T.StructType([T.StructField(header, T.StringType()) for header, _, _ in spec])


def typed(raw: DataFrame, spec: Spec) -> DataFrame:
    """Rename and type the raw columns; columns the table lacks are NULL."""
    present = set(raw.columns)
    return raw.select(*[
        CASTS[kind](F.col(f"`{header}`") if header in present else F.lit(None).cast("string")).alias(name)
        for header, name, kind in spec
    ])


def bad_columns(spec: Spec):
    """Array of the columns whose raw value is filled but could not be typed."""
    return F.array_compact(F.array(*[
        F.when(
            (F.trim(F.col(f"`{header}`")) != "") & CASTS[kind](F.col(f"`{header}`")).isNull(), F.lit(name)
        )
        for header, name, kind in spec if kind != "text"
    ]))


def split_bad_rows(raw: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(good rows typed, bad rows raw with `bad_columns`)."""
    marked = raw.withColumn("bad_columns", bad_columns(spec))
    good = marked.filter(F.size("bad_columns") == 0).drop("bad_columns")
    return typed(good, spec), marked.filter(F.size("bad_columns") > 0)

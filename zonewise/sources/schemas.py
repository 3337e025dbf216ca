"""Explicit schemas of the stored tables and of the tables that services fill."""

MUNICIPALITIES = "id LONG, name STRING, region STRING"
SCHOOLS = "id LONG, municipality_id LONG, name STRING, address STRING"
DECREES = "id LONG, municipality_id LONG, number STRING, date STRING, file_path STRING"
RULES = (
    "id LONG, school_id LONG, decree_id LONG, locality STRING, street STRING, normalized_street STRING, house_rule_raw STRING, rule_type STRING, parity STRING, house_from INT, house_to INT, "
    "house_number STRING, house_numbers STRING, exceptions STRING, comment STRING, dadata_value STRING, dadata_confidence STRING, validation_status STRING, validation_comment STRING"
)
#: Rows of raw tables: one row of one table on one page, by extraction engine and setting.
RAW_TABLES = "doc_id STRING, engine STRING, setting INT, page INT, table_ix INT, row_ix INT, cells ARRAY<STRING>"
#: Answers of a gazetteer by query; street is null where it knows the place but no street.
GAZETTEER = "query STRING, value STRING, street STRING"
REPLIES = "doc_id STRING, chunk INT, content STRING"
TABLES = {"municipalities": MUNICIPALITIES, "schools": SCHOOLS, "decrees": DECREES, "address_rules": RULES}

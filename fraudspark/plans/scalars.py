"""Column-function queries (SC). Text inputs are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.functions import dates, numbers, patterns, text
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles


def order_dates(r: Roles):
    """Order dates as the raw city files write them, with the usual bad values."""
    d = F.date_format("o_orderdate", "yyyyMMdd")
    kind = F.col("o_orderkey") % 6
    raw = (
        F.when(kind == 0, d)
        .when(kind == 1, F.concat(d, F.lit(".0")))
        .when(kind == 2, F.concat(F.lit("JUNE "), F.substring(d, 7, 2)))
        .when(kind == 3, F.concat(F.substring(d, 1, 4), F.lit("0229")))
        .when(kind == 4, F.concat(F.lit("1899"), F.substring(d, 5, 4)))
        .otherwise("")
    )
    return r.table("orders").select("o_orderkey", raw.alias("raw"))


@query("sc01_compact_date", """
    WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders),
    t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN d WHEN 1 THEN d || '.0' WHEN 2 THEN 'JUNE ' || substr(d, 7, 2)
                 WHEN 3 THEN substr(d, 1, 4) || '0229' WHEN 4 THEN '1899' || substr(d, 5, 4) ELSE '' END AS raw FROM d),
    n AS (SELECT *, CAST(TRY_CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT) AS VARCHAR) AS w FROM t),
    p AS (SELECT *, CAST(try_strptime(w, '%Y%m%d') AS DATE) AS x FROM n)
    SELECT o_orderkey, raw, CASE WHEN length(w) = 8 AND year(x) BETWEEN 1900 AND 2030 THEN x END AS parsed FROM p""")
def sc01(r: Roles):
    return order_dates(r).withColumn("parsed", dates.compact_date(F.col("raw")))


@query("sc02_portal_date", """
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4
                 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
                 WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%y') ELSE 'unknown' END AS raw, o_orderdate FROM orders)
    SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed,
           o_orderkey % 4 < 3 AS date_valid FROM t""")
def sc02(r: Roles):
    kind = F.col("o_orderkey") % 4
    raw = (
        F.when(kind == 0, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 2, F.date_format("o_orderdate", "M/d/yy"))
        .otherwise("unknown")
    )
    out = r.table("orders").select("o_orderkey", raw.alias("raw"))
    out = out.withColumn("parsed", dates.portal_date(F.col("raw")))
    return out.withColumn("date_valid", F.col("parsed").isNotNull())


@query("sc03_borough_name", """
    SELECT n_nationkey, n_name, CASE CAST(n_regionkey + 1 AS VARCHAR) WHEN '1' THEN 'Manhattan' WHEN '2' THEN 'Bronx'
      WHEN '3' THEN 'Brooklyn' WHEN '4' THEN 'Queens' WHEN '5' THEN 'Staten Island' END AS borough FROM nation""")
def sc03(r: Roles):
    return r.table("nation").select(
        "n_nationkey", "n_name", text.borough_name(F.col("n_regionkey") + 1).alias("borough")
    )


ADDRESS_SQL = """
    (SELECT s_suppkey, s_suppkey || ' ' || CASE s_suppkey % 4 WHEN 0 THEN 'Main Street' WHEN 1 THEN 'Fifth Avenue.'
        WHEN 2 THEN 'QUEENS BOULEVARD' ELSE 'Streetwise Rd' END || ', ' ||
        CASE s_suppkey % 7 WHEN 0 THEN 'NEW YORK' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'BRONX' WHEN 3 THEN 'STATEN ISLAND'
        ELSE n_name END || ' ' || CAST(10000 + s_suppkey % 90000 AS VARCHAR) AS address,
        s_name || CASE s_suppkey % 5 WHEN 0 THEN ' LLC' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' CORP, J. Doe' WHEN 3 THEN ' Ltd' ELSE '' END AS name
     FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def company_addresses(r: Roles):
    key = F.col("s_suppkey")
    street = (
        F.when(key % 4 == 0, "Main Street").when(key % 4 == 1, "Fifth Avenue.")
        .when(key % 4 == 2, "QUEENS BOULEVARD").otherwise("Streetwise Rd")
    )
    place = (
        F.when(key % 7 == 0, "NEW YORK").when(key % 7 == 1, "BROOKLYN").when(key % 7 == 2, "BRONX")
        .when(key % 7 == 3, "STATEN ISLAND").otherwise(F.col("n_name"))
    )
    suffix = (
        F.when(key % 5 == 0, " LLC").when(key % 5 == 1, ", Inc.").when(key % 5 == 2, " CORP, J. Doe")
        .when(key % 5 == 3, " Ltd").otherwise("")
    )
    zipcode = (10000 + key % 90000).cast("string")
    return r.table("supplier").join(r.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey",
        F.concat(key.cast("string"), F.lit(" "), street, F.lit(", "), place, F.lit(" "), zipcode).alias("address"),
        F.concat("s_name", suffix).alias("name"),
    )


CLEAN = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
NORM_ADDRESS = CLEAN.format(
    r"regexp_replace(regexp_replace(regexp_replace(upper(address), '\bSTREET\b', 'ST', 'g'), "
    r"'\bAVENUE\b', 'AVE', 'g'), '\bBOULEVARD\b', 'BLVD', 'g')"
)
NORM_NAME = CLEAN.format(r"regexp_replace(upper(name), '\b(LLC|INC|CORP|LTD)\b', '', 'g')")


@query("sc04_borough_in_text", f"""
    SELECT s_suppkey, CASE WHEN contains(address, 'MANHATTAN') OR contains(address, 'NEW YORK') THEN 'Manhattan'
      WHEN contains(address, 'BROOKLYN') THEN 'Brooklyn' WHEN contains(address, 'QUEENS') THEN 'Queens'
      WHEN contains(address, 'BRONX') THEN 'Bronx' WHEN contains(address, 'STATEN ISLAND') THEN 'Staten Island'
      ELSE 'Unknown' END AS borough FROM {ADDRESS_SQL}""")
def sc04(r: Roles):
    return company_addresses(r).select("s_suppkey", text.borough_in_text(F.col("address")).alias("borough"))


@query("sc05_zip_in_text", f"""
    SELECT s_suppkey, nullif(regexp_extract(address, '(\\d{{5}})', 1), '') AS zipcode FROM {ADDRESS_SQL}""")
def sc05(r: Roles):
    return company_addresses(r).select("s_suppkey", text.zip_in_text(F.col("address")).alias("zipcode"))


@query("sc06_normalize_address", f"SELECT s_suppkey, {NORM_ADDRESS} AS normalized FROM {ADDRESS_SQL}")
def sc06(r: Roles):
    return company_addresses(r).select("s_suppkey", text.normalize_address(F.col("address")).alias("normalized"))


@query("sc07_normalize_name", f"SELECT s_suppkey, {NORM_NAME} AS normalized FROM {ADDRESS_SQL}")
def sc07(r: Roles):
    return company_addresses(r).select("s_suppkey", text.normalize_name(F.col("name")).alias("normalized"))


@query("sc08_safe_numbers", """
    WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || CAST(event_id AS VARCHAR)
               ELSE CAST(event_id AS VARCHAR) || '.5' END AS raw FROM events)
    SELECT event_id, TRY_CAST(nullif(trim(raw), '') AS DOUBLE) AS as_double,
           CASE WHEN event_id % 4 = 2 THEN event_id END AS as_bigint FROM t""")
def sc08(r: Roles):
    key = F.col("event_id")
    raw = (
        F.when(key % 4 == 0, "").when(key % 4 == 1, "n/a").when(key % 4 == 2, F.concat(F.lit(" "), key.cast("string")))
        .otherwise(F.concat(key.cast("string"), F.lit(".5")))
    )
    rows = r.table("events").select("event_id", raw.alias("raw"))
    whole = numbers.to_number(F.when(~F.col("raw").contains("."), F.col("raw")), "bigint")
    return rows.select(
        "event_id", numbers.to_number(F.col("raw")).alias("as_double"), whole.alias("as_bigint")
    )


@query("sc09_small_expressions", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE AS ship, coalesce(nullif(l_returnflag, 'N'), '') AS filled,
           round(1.0 - l_linenumber / 10.0, 4)::DOUBLE AS similarity,
           CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS days_since,
           lower(trim(l_linestatus)) AS match_key, 'Job_' || l_orderkey AS doc_name,
           round(l_discount / nullif(l_tax, 0) * 100, 2) AS pct
    FROM lineitem""")
def sc09(r: Roles):
    rows = r.table("lineitem")
    ship = F.col("l_shipdate").cast("date")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ship.alias("ship"),
        F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("")).alias("filled"),
        F.round(numbers.distance_similarity(F.col("l_linenumber")), 4).alias("similarity"),
        F.datediff(ship, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days_since"),
        text.match_key(F.col("l_linestatus")).alias("match_key"),
        F.concat(F.lit("Job_"), F.col("l_orderkey").cast("string")).alias("doc_name"),
        numbers.percent(F.col("l_discount"), F.col("l_tax")).alias("pct"),
    )


@query("sc10_owner_name", """
    WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE '' END AS biz,
                 CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment ELSE '' END AS f, n_name AS l
               FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, CASE WHEN biz <> '' THEN biz WHEN f <> '' AND l <> '' THEN f || ' ' || l END AS owner_name FROM t""")
def sc10(r: Roles):
    key = F.col("c_custkey")
    rows = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    business = F.when(key % 3 == 0, F.col("c_name")).otherwise("")
    first = F.when(key % 3 < 2, F.col("c_mktsegment")).otherwise("")
    return rows.select("c_custkey", text.owner_name(business, first, F.col("n_name")).alias("owner_name"))


@query("sc11_address_line", """
    SELECT o_orderkey, trim(concat_ws(' ', CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END,
                                      CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END)) AS address FROM orders""")
def sc11(r: Roles):
    number = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string"))
    street = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority"))
    return r.table("orders").select("o_orderkey", text.join_words(number, street).alias("address"))


@query("sc12_address_hash", f"SELECT s_suppkey, md5({NORM_ADDRESS}) AS address_hash FROM {ADDRESS_SQL}")
def sc12(r: Roles):
    normalized = text.normalize_address(F.col("address"))
    return company_addresses(r).select("s_suppkey", text.address_hash(normalized).alias("address_hash"))


@query("sc13_edit_distance", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def sc13(r: Roles):
    rows = r.table("lineitem").join(r.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.levenshtein("p_name", "p_type").alias("distance")
    )


@query("sc15_markup", """
    SELECT o_orderkey, round(sum(l_extendedprice * (1 + l_tax)) / sum(l_extendedprice) - 1, 6) AS markup
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def sc15(r: Roles):
    sub = F.sum("l_extendedprice")
    total = F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")))
    rows = r.table("orders").join(r.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey").agg(F.round(numbers.markup(sub, total), 6).alias("markup"))


@query("sc16_cost_gap", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN p_retailprice > 0 AND l_extendedprice > 0
           THEN abs(l_extendedprice - p_retailprice) / p_retailprice END, 6) AS gap
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def sc16(r: Roles):
    rows = r.table("lineitem").join(r.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    gap = numbers.cost_gap(F.col("p_retailprice"), F.col("l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(gap, 6).alias("gap"))


@query("sc17_decay_weight", """
    SELECT o_orderkey, round(1.0 / (1.0 + (CAST(o_orderdate AS DATE) - DATE '1990-01-01') / 365.0), 8)::DOUBLE AS weight FROM orders""")
def sc17(r: Roles):
    base = F.lit("1990-01-01").cast("date")
    weight = dates.decay_weight(F.col("o_orderdate").cast("date"), base)
    return r.table("orders").select("o_orderkey", F.round(weight, 8).alias("weight"))


@query("sc20_first_three", """
    WITH d AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS rn FROM d)
    SELECT l_suppkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS firsts FROM k WHERE rn <= 3 GROUP BY 1""")
def sc20(r: Roles):
    sets = r.table("lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias("numbers"))
    return sets.select("l_suppkey", F.array_join(text.first_three(F.col("numbers")), ",").alias("firsts"))


@query("sc21_split_list", """
    SELECT part.p_partkey, list_count(string_split(x, ',')) AS n_items, trim(string_split(x, ',')[2]) AS second
    FROM (SELECT p_partkey, p_name || ' , ' || p_brand || ',' || p_type AS x FROM part) part""")
def sc21(r: Roles):
    joined = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(","), "p_type")
    rows = r.table("part").select("p_partkey", text.split_list(joined).alias("items"))
    return rows.select(
        "p_partkey", F.size("items").cast("bigint").alias("n_items"), F.col("items")[1].alias("second")
    )


@query("sc22_first_present", """
    SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN nullif(c_mktsegment, '') END, nullif(c_name, '')) AS value FROM customer""")
def sc22(r: Roles):
    first = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    return r.table("customer").select("c_custkey", text.first_present(first, F.col("c_name")).alias("value"))


@query("sc23_respondent_flags", f"""
    SELECT s_suppkey, contains(name, ',') AND regexp_matches(name, 'LLC|CORP|INC') AS multi_entity,
           contains(name, 'LLC') AS llc, length(name || address) > 50 AS long_name FROM {ADDRESS_SQL}""")
def sc23(r: Roles):
    name = F.col("name")
    return company_addresses(r).select(
        "s_suppkey", text.is_multi_entity(name).alias("multi_entity"), text.is_llc(name).alias("llc"),
        text.is_long_name(F.concat("name", "address")).alias("long_name"),
    )


@query("sc24_text_templates", """
    SELECT bin, 'Building ' || bin || ' with ' || count(*) || ' permits, ' || count(*) FILTER (job_status = 'R') || ' violations, '
           || count(*) FILTER (job_status = 'A') || ' complaints' AS summary FROM jobs GROUP BY 1""")
def sc24(r: Roles):
    counts = r.jobs().groupBy("bin").agg(
        F.count("*").alias("p"), F.count_if(F.col("job_status") == "R").alias("v"),
        F.count_if(F.col("job_status") == "A").alias("c"),
    )
    summary = F.format_string("Building %d with %d permits, %d violations, %d complaints", "bin", "p", "v", "c")
    return counts.select("bin", summary.alias("summary"))


@query("sc26_nested_struct", """
    SELECT o_orderkey, r_name AS borough, o_custkey || ' ' || n_name AS address
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def sc26(r: Roles):
    building = F.struct(
        "borough", text.join_words(F.col("owner_id").cast("string"), F.col("zipcode")).alias("address")
    )
    nested = r.properties().select(F.col("bin").alias("o_orderkey"), building.alias("building"))
    return nested.select("o_orderkey", "building.borough", "building.address")


@query("sc27_json_payload", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload FROM events""")
def sc27(r: Roles):
    return r.table("events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct("event_id", "event_type")).alias("payload"),
    )


@query("sc30_dataset_category", """
    SELECT item, CASE WHEN contains(item, 'permit') THEN 'permits' WHEN contains(item, 'violation') THEN 'violations'
      WHEN contains(item, 'complaint') THEN 'complaints' ELSE 'properties' END AS category
    FROM (SELECT DISTINCT source || '_' || CASE doc_id % 4 WHEN 0 THEN 'permits' WHEN 1 THEN 'ecb_violations'
          WHEN 2 THEN 'complaints' ELSE 'tax_lots' END AS item FROM documents)""")
def sc30(r: Roles):
    key = F.col("doc_id") % 4
    kind = (
        F.when(key == 0, "permits").when(key == 1, "ecb_violations").when(key == 2, "complaints").otherwise("tax_lots")
    )
    names = r.table("documents").select(F.concat_ws("_", "source", kind).alias("item")).distinct()
    return names.withColumn("category", patterns.dataset_category(F.col("item")))

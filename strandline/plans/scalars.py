"""Scalar functions. All stay in built-in expressions, so Spark compiles them into the scan stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.plans.registry import query
from strandline.sources import table


@query(
    """SELECT p_partkey, upper(p_name) AS name_upper, CAST(length(p_name) AS INTEGER) AS name_length,
        split_part(p_name, ' ', 1) AS first_word,
        CAST(len(string_split(p_name, ' ')) AS INTEGER) AS words,
        regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_number,
        regexp_replace(p_brand, '[0-9]', '*', 'g') AS brand_masked,
        substring(p_name, -3) AS name_end, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size_padded,
        concat_ws('/', p_brand, p_type) AS label, CAST(strpos(p_name, 'e') AS INTEGER) AS e_at,
        reverse(p_type) AS type_reversed, starts_with(p_type, 'S') AS type_s
    FROM part"""
)
def string_functions(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.upper("p_name").alias("name_upper"),
        F.length("p_name").alias("name_length"),
        words[0].alias("first_word"),
        F.size(words).alias("words"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_number"),
        F.regexp_replace("p_brand", "[0-9]", "*").alias("brand_masked"),
        F.substring("p_name", -3, 3).alias("name_end"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size_padded"),
        F.concat_ws("/", "p_brand", "p_type").alias("label"),
        F.instr("p_name", "e").alias("e_at"),
        F.reverse("p_type").alias("type_reversed"),
        F.startswith("p_type", F.lit("S")).alias("type_s"),
    )


@query(
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS fingerprint,
        CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines,
        contains(lower(text), 'the') AS has_the,
        CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER) AS digits
    FROM documents"""
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of whole texts."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length("text").alias("chars"),
        F.md5("text").alias("fingerprint"),
        F.size(F.split("text", "\n")).alias("lines"),
        F.contains(F.lower("text"), F.lit("the")).alias("has_the"),
        F.regexp_count("text", F.lit("[0-9]")).alias("digits"),
    )


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
        CAST(week(o_orderdate) AS INTEGER) AS iso_week, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday,
        CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
        o_orderdate + INTERVAL 1 MONTH AS month_later, o_orderdate + INTERVAL 36 HOURS AS later,
        CAST(last_day(o_orderdate) AS TIMESTAMP) AS month_end,
        CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_number,
        strftime(o_orderdate, '%Y-%m') AS month_name
    FROM orders"""
)
def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    date = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.year(date).alias("y"),
        F.quarter(date).alias("q"),
        F.weekofyear(date).alias("iso_week"),
        (F.dayofweek(date) - 1).alias("weekday"),
        F.date_trunc("month", date).cast("timestamp_ntz").alias("month_start"),
        (date + F.expr("INTERVAL 1 MONTH")).alias("month_later"),
        (date + F.expr("INTERVAL 36 HOURS")).alias("later"),
        F.last_day(date).cast("timestamp_ntz").alias("month_end"),
        F.datediff(date, F.lit("1995-01-01").cast("date")).alias("day_number"),
        F.date_format(date, "yyyy-MM").alias("month_name"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0) AS ratio,
        CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS unit_floor,
        CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS thousands, round(sqrt(l_quantity), 9) AS root,
        round(ln(l_extendedprice), 9) AS log_price, round(pow(1 + l_tax, 3), 9) AS growth,
        l_partkey % 7 AS slot, greatest(l_discount, l_tax) AS larger,
        CAST(sign(l_quantity - 25) AS DOUBLE) AS side, abs(l_quantity - 25) AS distance,
        round(l_extendedprice, 0) AS rounded
    FROM lineitem"""
)
def math_functions(spark: SparkSession, sf: str) -> DataFrame:
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.try_divide(price, F.col("l_discount")).alias("ratio"),
        F.floor(price / quantity).alias("unit_floor"),
        F.ceil(price / 1000).alias("thousands"),
        F.round(F.sqrt(quantity), 9).alias("root"),
        F.round(F.ln(price), 9).alias("log_price"),
        F.round(F.pow(1 + F.col("l_tax"), 3), 9).alias("growth"),
        F.pmod("l_partkey", F.lit(7)).alias("slot"),
        F.greatest("l_discount", "l_tax").alias("larger"),
        F.sign(quantity - 25).alias("side"),
        F.abs(quantity - 25).alias("distance"),
        F.round(price, 0).alias("rounded"),
    )


@query(
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims,
        CAST(list_max(embedding) AS DOUBLE) AS largest, CAST(embedding[1] AS DOUBLE) AS head,
        CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positives,
        round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6)
            AS squared_norm,
        CAST(list_min(list_slice(embedding, 9, 16)) AS DOUBLE) AS low_of_slice
    FROM embeddings"""
)
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    values = F.col("embedding")
    squares = F.transform(values, lambda x: x.cast("double") * x.cast("double"))
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.size(values).alias("dims"),
        F.array_max(values).cast("double").alias("largest"),
        values[0].cast("double").alias("head"),
        F.size(F.filter(values, lambda x: x > 0)).alias("positives"),
        F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 6).alias("squared_norm"),
        F.array_min(F.slice(values, 9, 8)).cast("double").alias("low_of_slice"),
    )


@query(
    """SELECT p_partkey, CAST(generate_subscripts(w, 1) AS INTEGER) - 1 AS place, unnest(w) AS word
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"""
)
def array_explode(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word"))


@query(
    """SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, event_type || ',k' AS names,
        CAST(2 AS INTEGER) AS entries, CAST(props->>'$.k' AS DOUBLE) + value AS total,
        false AS has_other
    FROM events"""
)
def map_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Properties as a map, joined with a map made from columns."""
    props = F.from_json("props", "map<string, double>")
    both = F.map_concat(F.create_map("event_type", "value"), props)
    total = F.aggregate(F.map_values(both), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "events").select(
        "event_id",
        F.element_at(props, "k").cast("int").alias("k"),
        F.array_join(F.map_keys(both), ",").alias("names"),
        F.size(both).alias("entries"),
        total.alias("total"),
        F.map_contains_key(both, "other").alias("has_other"),
    )


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text,
        CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing,
        '{"t":"' || event_type || '","u":' || user_id || '}' AS packed
    FROM events"""
)
def json_functions(spark: SparkSession, sf: str) -> DataFrame:
    packed = F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u")))
    return table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k_text"),
        F.from_json("props", "k int")["k"].alias("k"),
        F.get_json_object("props", "$.none").alias("missing"),
        packed.alias("packed"),
    )

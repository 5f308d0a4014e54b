"""The queries of this package and their SQL twins."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import credentials, exact, mixing, packing, pages, periods, quality, sharding, simhash, spellings, substrings, topk, toxicity
from strandline.llm.common import text_or_empty, word_count
from strandline.plans.registry import Build, Query
from strandline.sources import table

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return add


# The CRC-32 of a list ``bytes``. The table entry of a byte is the xor of the entries of its bits;
# fixed values, for the bits from the lowest.
CRC_BITS = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)


def _sql_crc() -> str:
    step = "c >> 8"
    for n, entry in enumerate(CRC_BITS):
        step = f"xor({step}, ((xor(c, b) >> {n}) & 1) * {entry})"
    return f"xor(list_reduce(bytes, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


SQL_CRC = _sql_crc()


@query(
    """WITH ranked AS (
        SELECT doc_id, source, coalesce(text, '') AS body,
            row_number() OVER w AS nth, count(*) OVER (PARTITION BY source) AS of
        FROM documents
        WINDOW w AS (PARTITION BY source ORDER BY md5('3:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id)
    ), placed AS (
        SELECT *, row_number() OVER (ORDER BY CAST(2 * nth - 1 AS DOUBLE) / (2 * of),
            source IS NULL, coalesce(source, ''), nth) - 1 AS place, count(*) OVER () AS n
        FROM ranked
    ), cut AS (
        SELECT *, CAST(place * 16 // n AS INTEGER) AS shard,
            list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
        FROM placed
    )
    SELECT doc_id, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size, """
    + SQL_CRC
    + """ AS text_crc32, 'rows' AS law, shard,
        CAST(place - (shard * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM cut"""
)
def op3_stratified_shards(spark: SparkSession, sf: str) -> DataFrame:
    body = text_or_empty("text")
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.interleave(docs, 16, keep=("size", "text_crc32"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    r"""WITH sized AS (
        SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source,
            md5('4:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
        FROM documents
    ), sources AS (
        SELECT none, source, CAST(sum(size) AS BIGINT) AS total,
            CAST((row_number() OVER (ORDER BY none, source) - 1) % 3 + 1 AS DOUBLE) AS weight
        FROM sized GROUP BY none, source
    ), leveled AS (
        SELECT *, (CAST(sum(total) OVER () AS BIGINT) - CAST(coalesce(sum(3 * total) OVER upto, 0) AS BIGINT))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0)) AS level
        FROM sources
        WINDOW upto AS (ORDER BY 3 * total / weight, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), plan AS (
        SELECT *, least(CAST(3 * total AS DOUBLE),
            coalesce((SELECT level FROM leveled WHERE level * weight <= 3 * total ORDER BY 3 * total / weight, none, source LIMIT 1), 0)
            * weight) AS target
        FROM leveled
    ), queued AS (
        SELECT s.*, total, weight, target, CAST(sum(size) OVER (
            PARTITION BY none, source ORDER BY mixed, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
        FROM sized s JOIN plan USING (none, source)
    ), copies AS (
        SELECT *, (lap * total + upto) / weight AS finish FROM queued, range(3) AS laps(lap) WHERE size > 0
    ), line AS (
        SELECT *, sum(size) OVER (ORDER BY finish, none, source, lap, upto ROWS UNBOUNDED PRECEDING) AS run FROM copies
    ), times AS (
        SELECT none, source, doc_id, upto, count(*) AS times FROM line
        WHERE run <= (SELECT sum(total) FROM sources) GROUP BY ALL
    )
    SELECT q.doc_id, size, total AS source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken
    FROM queued q LEFT JOIN times t
        ON q.none = t.none AND q.source = t.source AND q.upto = t.upto AND q.doc_id IS NOT DISTINCT FROM t.doc_id"""
)
def op4_fair_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.fair_queue(docs, word_count("text")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    """WITH hashed AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
        doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM hashed WINDOW g AS (PARTITION BY text_sha256)"""
)
def op7_exact_copies(spark: SparkSession, sf: str) -> DataFrame:
    return exact.copies(table(spark, sf, "documents"))


@query()
def op8_subword_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op10_attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op2_least_slack_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op5_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    r"""WITH split AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS id FROM documents
    ), windows AS (
        SELECT id, unnest(range(1, len(words) - 33)) AS spot, words FROM split
    ), keyed AS (
        SELECT id, spot, md5(array_to_string(words[spot : spot + 34], ' ')) AS k FROM windows
    ), twice AS (
        SELECT id, spot FROM keyed QUALIFY count(*) OVER (PARTITION BY k) > 1
    ), hit AS (
        SELECT DISTINCT id, spot + step AS spot FROM twice, range(35) AS steps(step)
    ), gone AS (
        SELECT id, count(*) AS n, list(spot) AS spots FROM hit GROUP BY id
    ), numbered AS (
        SELECT s.id, unnest(s.words) AS word, generate_subscripts(s.words, 1) AS spot FROM split s
    ), left_over AS (
        SELECT n.id, string_agg(n.word, ' ' ORDER BY n.spot) AS rest
        FROM numbered n ANTI JOIN hit h ON n.id = h.id AND n.spot = h.spot GROUP BY n.id
    )
    SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(l.rest, '')) AS kept_sha256
    FROM split s LEFT JOIN gone g ON s.id = g.id LEFT JOIN left_over l ON s.id = l.id"""
)
def op6_super_kmer_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    """WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
        FROM whole q JOIN whole d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 5"""
)
def op9_cover_tree_top5(spark: SparkSession, sf: str) -> DataFrame:
    return topk.nearest(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


@query()
def op1_page_differences(spark: SparkSession, sf: str) -> DataFrame:
    return pages.main_text(table(spark, sf, "pages"))


def _slipped(key: str, run: str) -> str:
    """The contract's slips of the pen: where 97 divides the CRC-32 of a row's key and a run, one of its letters is missing."""
    h = zlib.crc32(f"{key}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


@query(
    r"""WITH runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, row_number() OVER () AS id,
            unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents
    ), counted AS (
        SELECT name, run, count(*) AS n FROM runs GROUP BY ALL
    ), spelt AS (
        SELECT *, list_transform(regexp_extract_all(hex(encode(name || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM counted
    ), hashed AS (
        SELECT run, n, """
    + SQL_CRC
    + """ AS h FROM spelt
    ), slipped AS (
        SELECT n, CASE WHEN h % 97 = 0 THEN run[1 : h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word FROM hashed
    ), words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ), shorter AS (
        SELECT word, n, place, word[1 : place - 1] || word[place + 1 :] AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS place FROM words)
    ), near AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest
        UNION SELECT b.word, a.word, a.n FROM words a JOIN shorter b ON a.word = b.rest
    ), best AS (
        SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM near GROUP BY word
    ), forms AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 2 * w.n THEN b.best_n END AS form_n,
            CASE WHEN b.best_n >= 2 * w.n THEN (SELECT min(near) FROM near x WHERE x.word = w.word AND x.near_n = b.best_n) END AS form
        FROM words w LEFT JOIN best b ON w.word = b.word
    ), led AS (
        WITH RECURSIVE step(word, spot, next) AS (
            SELECT word, word, form FROM forms
            UNION ALL SELECT s.word, f.word, f.form FROM step s JOIN forms f ON s.next = f.word
        ) SELECT word, spot FROM step WHERE next IS NULL
    )
    SELECT f.word, l.spot AS root, f.form, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON f.word = l.word"""
)
def op11_letter_count_trie(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.variants(spellings.occurrences(table(spark, sf, "documents"), change=_slipped))


SQL_SPANS = """(SELECT id, '{kind}' AS kind, {order} AS nth, start, start + len(hit) AS stop, hit, {value} AS value FROM (
        SELECT id, hit, CAST(sum(len(piece) + len(hit)) OVER (PARTITION BY id ORDER BY spot) - len(hit) AS BIGINT) AS start FROM (
            SELECT id, unnest(hits) AS hit, unnest(pieces[1 : len(hits)]) AS piece, generate_subscripts(hits, 1) AS spot FROM (
                SELECT id, regexp_extract_all(body, pattern) AS hits, regexp_split_to_array(body, pattern) AS pieces
                FROM texts, (SELECT '{pattern}' AS pattern)) WHERE len(hits) > 0)) WHERE {fit})"""
SQL_NAMED = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?"""
)
SQL_VALUE = "[A-Za-z0-9+/_.=-]+"
SQL_LIVE = "(len(value) >= 16 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]'))"
_NAMED_VALUE = f"regexp_extract(hit, '^{SQL_NAMED}({SQL_VALUE})$', 1)"


@query(
    "WITH texts AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS body FROM documents), base AS (SELECT * FROM "
    + SQL_SPANS.format(kind="assign", order=0, pattern=f"{SQL_NAMED}{SQL_VALUE}", value=_NAMED_VALUE, fit=f"len({_NAMED_VALUE}) >= 6")
    + " UNION ALL SELECT * FROM "
    + SQL_SPANS.format(kind="access", order=1, pattern="AKIA[A-Z0-9]+", value="hit", fit="len(hit) >= 20")
    + " UNION ALL SELECT * FROM "
    + SQL_SPANS.format(kind="hex", order=2, pattern="[0-9a-f]+", value="hit", fit="len(hit) >= 24")
    + "), bare AS (SELECT * FROM "
    + SQL_SPANS.format(kind="token", order=3, pattern="[A-Za-z0-9+/_=-]{{20,}}".format(), value="hit", fit="regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')")
    + f"""), spans AS (
        SELECT *, {SQL_LIVE} AS live FROM base
        UNION ALL SELECT *, true FROM bare WHERE {SQL_LIVE}
            AND NOT EXISTS (SELECT 1 FROM base WHERE base.id = bare.id AND base.start < bare.stop AND bare.start < base.stop)
    ), owners AS (
        SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(source, chr(0)) || ':' || doc_id) AS places
        FROM spans JOIN texts USING (id) GROUP BY value
    ), known AS (
        SELECT s.*, owners >= 3 OR places >= 20 AS copied, live AND owners < 3 AND places < 20 AS owned, concat_ws(':', kind, start, stop) AS span
        FROM spans s JOIN owners USING (value)
    ), listed AS (
        SELECT id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
            string_agg(span, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(span, ',' ORDER BY start, nth) AS spans,
            string_agg(span, ',' ORDER BY start, nth) FILTER (copied) AS copied, string_agg(span, ',' ORDER BY start, nth) FILTER (owned) AS owned,
            count(*) FILTER (nth = 3) AS n_token, count(*) FILTER (copied) AS n_copied, count(*) FILTER (owned) AS n_owned
        FROM known WHERE nth < 3 OR owned GROUP BY id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(copied, '') AS copied, coalesce(owned, '') AS owned, coalesce(n_token, 0) AS n_token,
        coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned
    FROM texts LEFT JOIN listed USING (id)"""
)
def op12_secret_owners(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.secrets(table(spark, sf, "documents"))


def _repeating(key: str | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted periods: one text in ten repeats a stretch of its words to its end."""
    h = zlib.crc32(("" if key is None else key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query(
    r"""WITH named AS (
        SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS given,
            list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
        FROM documents
    ), hashed AS (
        SELECT id, doc_id, given, len(given) AS n, """
    + SQL_CRC
    + """ AS h FROM named
    ), aimed AS (
        SELECT *, h // 10 % greatest(n, 1) AS a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) AS p FROM hashed
    ), planted AS (
        SELECT id, doc_id, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
            ELSE given END AS words FROM aimed
    ), spelt AS (
        SELECT id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM planted
    ), sixes AS (
        SELECT id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w
            || ' ' || lead(word, 5) OVER w AS six FROM spelt WINDOW w AS (PARTITION BY id ORDER BY i)
    ), again AS (
        SELECT a.id, a.i, b.i - a.i AS q FROM sixes a JOIN sixes b ON a.id = b.id AND a.six = b.six AND a.i < b.i
    ), stretches AS (
        SELECT id, q, min(i) AS start, count(*) + 5 + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM again) GROUP BY id, q, island
    ), runs AS (
        SELECT id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY id, start, length
    ), gone AS (
        SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs
    ), rest AS (
        SELECT s.id, string_agg(word, ' ' ORDER BY s.i) AS kept FROM spelt s ANTI JOIN gone g ON s.id = g.id AND s.i = g.i GROUP BY s.id
    ), listed AS (
        SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
            first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best
        FROM runs GROUP BY id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM planted LEFT JOIN listed USING (id) LEFT JOIN rest USING (id)"""
)
def op13_basic_factor_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf, "documents"), change=_repeating)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )

"""Secrets in texts: spans by pattern, sorted out by who owns their values over the whole corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import stash

KINDS = ("assign", "access", "hex", "token")
ASSIGN, ACCESS, HEX, TOKEN = range(4)

# On a text whose A-Z are lower-cased; the value, group 2, is read from the text itself.
NAMED = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
LEAST_VALUE = 6
KEY = re.compile(r"AKIA[A-Z0-9]{16,}")
DIGITS = re.compile(r"[0-9a-f]{24,}")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# A value that looks live has so many characters, so many different ones, a digit and a letter.
LIVE_LENGTH, LIVE_VARIETY = 16, 8
# A value found with so many owners, or in so many repositories, is an example that people copy.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 20

SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("live", pa.bool_())])


def looks_live(value: str) -> bool:
    """Whether a value is long and varied enough, with letters and digits, to be a credential and no placeholder."""
    return len(value) >= LIVE_LENGTH and len(set(value)) >= LIVE_VARIETY and re.search("[0-9]", value) is not None and re.search("[A-Za-z]", value) is not None


def mixed(value: str) -> bool:
    return all(re.search(c, value) for c in ("[0-9]", "[A-Z]", "[a-z]"))


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """Kind, start, end (code points) and value of what a text has by pattern, by start and kind.

    ``assign``, ``access`` and ``hex`` spans are found each by itself. ``token`` spans are bare strings of mixed case and digits that
    look live and overlap none of those; whether they count is up to the corpus.
    """
    lower = text.encode().lower().decode()
    found = [(m.start(), ASSIGN, m.end(), text[m.start(2) : m.end(2)]) for m in NAMED.finditer(lower) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), ACCESS, m.end(), m.group()) for m in KEY.finditer(text)]
    found += [(m.start(), HEX, m.end(), m.group()) for m in DIGITS.finditer(text)]
    found.sort()
    bare = [(m.start(), TOKEN, m.end(), m.group()) for m in BARE.finditer(text) if mixed(m.group()) and looks_live(m.group())]
    n, reach, free = 0, 0, []
    for span in bare:
        while n < len(found) and found[n][0] < span[2]:
            reach, n = max(reach, found[n][2]), n + 1
        if reach <= span[0]:
            free.append(span)
    return [(kind, start, end, value) for start, kind, end, value in sorted(found + free)]


def _named(span: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), span["kind"].cast("int") + 1)
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))


def _found(docs: DataFrame, key: str, text: str, repository: str, owner: str) -> DataFrame:
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text_ in batch.column("body").to_pylist():
                found = spans_of(text_ or "")
                base = [s for s in found if s[0] != TOKEN]
                counts.append([sum(s[0] == k for s in base) for k in (ASSIGN, ACCESS, HEX)])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest())
                spans.append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).digest(), "live": looks_live(v)} for k, a, b, v in found])
            columns = [batch.column(c) for c in ("key", "repository", "owner", "row")]
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.array(spans, pa.list_(SPAN))], names)

    names = ["key", "repository", "owner", "row", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    given = docs.select(
        F.col(key).alias("key"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("body"),
    )
    kind = given.schema["key"].dataType.simpleString()
    schema = f"key {kind}, repository string, owner string, row long, n_assign long, n_access long, n_hex long, base_sha256 string"
    return given.mapInArrow(scanned, schema + ", spans array<struct<kind: tinyint, start: long, end: long, value: binary, live: boolean>>")


def ownership(spans: DataFrame) -> DataFrame:
    """For each ``value`` of ``spans`` (with ``repository`` and ``owner``) how many owners and repositories have it.

    A repository is named by its owner and its own name. Each step adds up per task first, so that a value found
    everywhere sends a row a task.
    """
    places = spans.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """The secrets of every text: a row a document.

    Returns ``key``, ``n_assign``, ``n_access``, ``n_hex`` (spans by pattern), ``base_sha256`` (of those, as kind:start:end
    by start, then kind as listed in ``KINDS``, joined by commas), ``spans`` (those and the ``token`` spans that the corpus adds, alike), ``copied``
    and ``owned`` (parts of ``spans``), ``n_token``, ``n_copied`` and ``n_owned``.

    Values are gathered over all documents by their SHA-256. One with ``COPIED_OWNERS`` owners or in ``COPIED_REPOSITORIES``
    repositories or more is a widely copied example; any other that looks live is owned: a credential of
    its owner. Bare tokens count only if they are owned. Where the corpus has no better names, a document is a repository and its source
    the owner.

    Texts are read once, whole, where they lie; only spans move, none of a document without any. Their table is
    written to the shared scratch folder, so that adaptive execution can split the join of a value found everywhere. A
    null text equals an empty one and has no spans. Null owners are one owner, null repositories one of each owner;
    repeated rows are one repository, each with its own spans. Extra columns are not read; an empty table gives an empty
    result.
    """
    found = stash(_found(docs, key, text, repository, owner), "secrets")
    plain = ["key", "n_assign", "n_access", "n_hex", "base_sha256"]
    holders = found.where(F.size("spans") > 0)
    spans = holders.select("row", "repository", "owner", F.explode("spans").alias("span")).select("row", "repository", "owner", "span.*")
    owners = stash(ownership(spans), "ownership")
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)
    sorted_out = spans.join(owners, "value").select("row", "kind", "start", "end", copied.alias("copied"), (F.col("live") & ~copied).alias("owned"))
    sorted_out = sorted_out.where((F.col("kind") != TOKEN) | F.col("owned"))
    listed = sorted_out.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "copied", "owned"))).alias("kept"))
    some = holders.select("row", *plain).join(listed, "row", "left").drop("row")
    none = found.where(F.size("spans") == 0).select(*plain, F.lit(None).cast(listed.schema["kept"].dataType).alias("kept"))

    def texts(part: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(part, _named), ","), F.lit(""))

    def many(part: Column) -> Column:
        return F.coalesce(F.size(part), F.lit(0)).cast("long")

    kept = F.coalesce("kept", F.array().cast(listed.schema["kept"].dataType))
    examples, owned = F.filter(kept, lambda s: s["copied"]), F.filter(kept, lambda s: s["owned"])
    return some.unionByName(none).select(
        F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256",
        texts(kept).alias("spans"), texts(examples).alias("copied"), texts(owned).alias("owned"),
        many(F.filter(kept, lambda s: s["kind"] == TOKEN)).alias("n_token"), many(examples).alias("n_copied"), many(owned).alias("n_owned"),
    )

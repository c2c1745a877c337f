"""Secret scan with corpus-wide ownership: who else has the same credential tells an example from a live one."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, fresh, small

#: Kinds in the order that spans are listed; the last one is added by the method.
KINDS = ("assign", "access", "hex", "live")
#: A value that so many owners have, or so many repositories of whatever owners, is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 50
#: Entropy of a live-looking value, in bits a character.
LIVE_BITS = 3.0
#: What stands for a redacted span.
MASK = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
_OTHER = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_STEMS = ("pass", "secret", "token", "api")


def lively(value: str) -> bool:
    """Looks drawn by chance: letters and digits of at least LIVE_BITS bits of entropy a character."""
    n = len(value)
    if n < 16 or value.isalpha() or not any(c.isalpha() for c in value):
        return False
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LIVE_BITS


def scan(text: str) -> list[tuple[int, int, int, bytes, bool]]:
    """All candidates (kind, start, end, digest of the value, lively) of a whole text, by start and kind.

    Offsets are code points. Within a kind they are leftmost and don't overlap;
    an assignment whose value has under 6 characters and an access key under 20
    are dropped after matching. Other long tokens count if they look lively and
    touch none of these.
    """
    found = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        found += [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    at = reach = 0
    for m in _OTHER.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= s and lively(m[0]):
            found.append((3, s, e, m[0]))
    digest = lambda v: hashlib.blake2b(v.encode(), digest_size=16).digest()
    return sorted(((k, s, e, digest(v), lively(v)) for k, s, e, v in found), key=lambda x: (x[1], x[0]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


_ROW = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("base_spans", T.StringType()),
        T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("lively", T.BooleanType())]))),
    ]
)


@F.arrow_udf(_ROW)
def _scan(text: pa.Array) -> pa.Array:
    rows = []
    for t in text.to_pylist():
        found = scan(t)
        base = [x for x in found if x[0] < 3]
        kinds = [x[0] for x in base]
        line = joined(base)
        each = [dict(zip(("kind", "start", "stop", "digest", "lively"), x, strict=True)) for x in found]
        rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(line.encode()).hexdigest(), line, each))
    return pa.array([dict(zip(_ROW.names, r, strict=True)) for r in rows], to_arrow_type(_ROW))


_scan = _scan.asNondeterministic()  # so that a filter on its result doesn't scan again


def ownership(candidates: DataFrame) -> DataFrame:
    """(digest, owner, repository) rows to (digest, n_owners, n_repositories), both distinct, null counting as one.

    Three aggregations with partial sums: a value that a third of all rows have
    reaches a task as one row per repository, then owner, and map task.
    """
    by = candidates.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    by = by.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def judged(rows: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(row, owner, repository, candidates) to (row, kind, start, stop, verdict): example, live or plain.

    example: ``example_owners`` or more have the value, or it stands in
    ``example_repositories`` or more. live: neither, and it looks drawn by
    chance. plain: the rest. Only examples are joined back, by a left join
    whose hot values can be split.
    """
    each = rows.select("row", "owner", "repository", F.inline("candidates"))
    known = ownership(each.select("digest", "owner", "repository"))
    wide = known.where((F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)).select("digest", F.lit(True).alias("wide"))
    verdict = F.when(F.col("wide"), "example").when(F.col("lively"), "live").otherwise("plain")
    return each.join(small(cut(wide)), "digest", "left").select("row", "kind", "start", "stop", verdict.alias("verdict"))


def _repository(repository: str | None) -> Column:
    """None: the text, so that copies of one count once."""
    return F.xxhash64("text").cast("string") if repository is None else F.col(repository).cast("string")


def scan_documents(docs: DataFrame, owner: str = "source", repository: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Base spans always stay; a live token of another form is added, one that is
    an example isn't. A null text counts as empty: no span, the hash of the
    empty string. Null owners are one owner; repeated rows each have a row, and
    copies of a text are one repository unless a column names it. Only candidates are shuffled, and of
    the documents their counts, never texts.
    """
    rows = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), _repository(repository).alias("repository"), _scan(F.coalesce("text", F.lit(""))).alias("s"))
    rows = cut(rows.select("doc_id", "owner", "repository", "s.*"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # stable: of a checkpoint's partitions
    some = rows.where(F.size("candidates") > 0)
    spans = judged(some, example_owners).where("kind < 3 or verdict = 'live'")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", name, "start", "stop").alias("text"))))
    spans = spans.groupBy("row").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ",").alias("spans"), F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"))
    base = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    with_ = some.join(spans, "row", "left").select(*base, F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
    without = rows.where(F.size("candidates") == 0).select(*base, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return with_.union(without)


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, some in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if some is not None and len(some):
            parts, at = [], 0
            for s, e in sorted((x["start"], x["stop"]) for x in some):
                if s >= at:
                    parts += [t[at:s], MASK]
                at = max(at, e)
            t = "".join([*parts, t[at:]])
        out.append(t)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, owner: str = "source", repository: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with every span that isn't a widely copied example replaced by MASK; n_chars, if there, follows the text.

    All rows and columns stay; a text without such a span is left alone, null included.
    """
    key = [F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash")]
    rows = docs.where("text is not null").select(*key, F.col(owner).cast("string").alias("owner"), _repository(repository).alias("repository"), _scan("text").alias("s"))
    rows = cut(rows.select(F.struct("row_id", "row_hash").alias("row"), "owner", "repository", F.col("s.candidates").alias("candidates")).where(F.size("candidates") > 0))
    spans = judged(rows, example_owners).where("verdict != 'example' and (kind < 3 or verdict = 'live')")
    spans = cut(spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select("row.*", "spans"))
    h, text, found = fresh(docs, "row_hash"), fresh(docs, "new_text"), fresh(docs, "spans")
    spans = spans.select(F.col("row_id").alias("id_"), F.col("row_hash").alias("hash_"), F.col("spans").alias(found))
    named = docs.withColumn(h, F.xxhash64("text"))
    out = named.join(small(spans), named["doc_id"].eqNullSafe(spans["id_"]) & (named[h] == spans["hash_"]), "left")
    out = out.withColumn(text, F.when(F.col(found).isNotNull(), _redacted("text", found)).otherwise(F.col("text")))
    values = {"text": F.col(text)} | ({"n_chars": F.when(F.col(found).isNotNull(), F.length(text)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[values[c].alias(c) if c in values else docs[c] for c in docs.columns])

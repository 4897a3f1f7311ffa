"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Candidates come from three base patterns and one generic pattern for bare credential-like runs. Every
candidate's value is hashed; the hashes are aggregated over the corpus by distinct repositories and distinct
owners. A value that `min_owners` owners or more hold is a widely copied *example*, unless one owner has more than
`most` of the repositories that hold it: then it is that owner's credential, which some others have copied. All other
values are *live*, in however many repositories of one owner they are. Base spans are always reported; a generic span
is added only if it lies apart from base spans and its value is live, so the ownership count is what separates a
credential from a digest, licence id or sample key that everybody pastes.

Defined results: null text is empty (no spans); a null owner or repository counts as one owner or repository of
its own (the empty name); repeated rows each get their own spans and count once per distinct owner/repository;
an empty table gives an empty result; other columns are carried untouched inside a struct, so any names may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole run of the characters that values have, at least 20 without dot and equals sign, with two digits and a letter.
GENERIC = (
    r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])"
    r"[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_.=-])"
)
#: For redaction also runs after '=', before a full stop that ends a sentence, with '=' padding, and three dotted parts (JWT).
#: A dot within a run is still no border: parts of addresses and file names aren't candidates.
BARE = (
    r"(?<![A-Za-z0-9+/_-])(?<![A-Za-z0-9+/_=-]\.)(?:eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}|"
    r"(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+)(?![A-Za-z0-9+/_=-]|\.[A-Za-z0-9+/_=-])"
)
HIT = "array<struct<kind:int,k:int,gap:int,hit:int,hash:string>>"
EXAMPLES = 200_000  # hashes of examples that go to every task


def _hits(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """All leftmost non-overlapping matches in order: the length of what lies before each, its own, and its value's hash (null if it fails)."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(between.alias("gap"), whole.alias("hit"), value.alias("value"))
    hash_of = lambda r: F.when(F.length(r["value"]) >= least, F.sha2(r["value"], 256))
    found = F.transform(rows, lambda r, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(r["gap"]).alias("gap"), F.length(r["hit"]).alias("hit"), hash_of(r).alias("hash")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HIT))


def candidate_hits(text: Column, generic: str = GENERIC) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(_hits(text, ASSIGN, 0, 2, 6), _hits(text, ACCESS, 1, 0, 20), _hits(text, HEX, 2, 0, 24), _hits(text, generic, 3, 0, 20))


def located(hits: DataFrame) -> DataFrame:
    """Rows of hits (rid, owner, repo, kind, k, gap, hit, hash) → spans in code points, generic ones only where they lie
    apart from base spans. Running sums and running ends: the work follows the number of hits, also in one text."""
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    spans = hits.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("hit")).filter("hash is not null")
    base = F.col("kind") < 3
    before = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(behind))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return reached.filter(base | apart).select("rid", "owner", "repo", "kind", "start", "end", "hash")


def ownership(candidates: DataFrame, min_owners: int, most: float = 0.9) -> DataFrame:
    """hash → n_owners, n_repos, example. Each step pre-aggregates map-side, so a value in a third of all rows is cheap."""
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    spread = (F.count("*") >= min_owners) & (F.max("repos") <= most * F.sum("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"), spread.alias("example"))


def scan_secrets(docs: DataFrame, *, text: str = "text", owner: str = "source", repo: str = "doc_id", min_owners: int = 3, most: float = 0.9, generic: str = GENERIC) -> DataFrame:
    """`row` (the input row as a struct) and `spans`: array of (start, kind, end, example), kind an index of KINDS.

    Generic spans are kept only if live. Texts never move: rows without a candidate leave straight from the scan,
    the few with one are written to the shared folder once, and only their spans are joined with the examples' hashes.
    """
    name = lambda c: F.col("row").getField(c)
    scanned = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("found", candidate_hits(name(text), generic))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>")
    clean = scanned.filter(F.size("found") == 0).select("row", none.alias("spans"))
    hit = materialise(scanned.filter(F.size("found") > 0).withColumn("rid", F.monotonically_increasing_id()), "secret-candidates")
    flat = hit.select("rid", F.coalesce(name(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(name(repo).cast("string"), F.lit("")).alias("repo"), F.inline("found"))
    spans = materialise(located(flat), "secret-spans")
    examples = ownership(spans, min_owners, most).filter("example").select("hash", "example")
    examples = F.broadcast(examples) if examples.count() <= EXAMPLES else examples
    judged = spans.join(examples, "hash", "left").withColumn("example", F.coalesce("example", F.lit(False)))
    kept = judged.filter((F.col("kind") < 3) | ~F.col("example"))
    by_row = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "example"))).alias("spans"))
    with_spans = hit.select("rid", "row").join(by_row, "rid", "left").select("row", F.coalesce("spans", none).alias("spans"))
    return clean.unionByName(with_spans)


def _written(spans: Column) -> Column:
    label = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", label[s["kind"]], s["start"], s["end"])), ",")


def secret_digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest columns of scan_secrets' rows."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    number = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("row").getField(doc_id).alias("doc_id"),
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["example"])).cast("long").alias("n_example"),
        F.size(F.filter(spans, lambda s: ~s["example"])).cast("long").alias("n_live"),
    )


def redact(docs: DataFrame, *, text: str = "text", live: str = "<SECRET>", example: str = "<EXAMPLE>", generic: str = BARE, **how) -> DataFrame:
    """The input's columns, each run of overlapping spans replaced: by `live` if any span in it is live, else by `example`."""
    scanned = scan_secrets(docs, text=text, generic=generic, **how)
    row, body = F.col("row"), F.coalesce(F.col("row").getField(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit("").alias("mark"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["example"], F.lit(example)).otherwise(F.lit(live))
        fresh = (s["start"] >= acc["at"]) | (acc["mark"] == "")
        both = F.when((acc["mark"] == live) | ~s["example"], F.lit(live)).otherwise(F.lit(example))
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], acc["mark"], gap)).otherwise(acc["out"]).alias("out"),
            F.when(fresh, mark).otherwise(both).alias("mark"),
        )

    rest = lambda acc: F.concat(acc["out"], acc["mark"], F.substring(body, acc["at"] + 1, F.length(body)))
    cleaned = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(row.getField(text))
    columns = [
        cleaned.alias(c) if c == text else F.when(F.size("spans") > 0, F.length(cleaned).cast(docs.schema[c].dataType)).otherwise(row.getField(c)).alias(c) if c == "n_chars" else row.getField(c).alias(c)
        for c in docs.columns
    ]
    return scanned.select(*columns)

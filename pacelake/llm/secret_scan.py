r"""Secret scans that weigh candidates by how widely the corpus owns them.

Three fixed patterns give the base spans of a text (assign, access, hex). A fourth, wider pattern gives
candidates: long opaque strings outside the base spans. Every candidate's hash is aggregated over the
corpus by distinct owners and repositories. One that at least min_owners owners hold is an example that
was copied around; one that fewer hold looks like a live credential of its owner and adds a span of kind
"owned". The same counts sort the base spans into live-looking ones and copied examples; they are
reported, and base spans always stay.

Everything is column expressions: a pattern's matches are fenced with two noncharacters and the text is
split there; positions are running sums of the parts' lengths, made in windows over the matches of a row, so that
the work grows with a text and not with the square of its matches.

Defined results: a null text counts as empty; a null owner or repository counts as one of its own; the
columns owner and repository may be missing from the table (then one owner holds all); other columns are
ignored; repeated rows are scanned each, and count once for ownership; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import let
from .common import Scratch, dealt, text_or_empty

#: Fixed patterns of the base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Candidates of the fourth kind: a long run with a capital, a small letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{28,}"
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def _matches(text: Column, kind_no: int, pattern: str, value_group: int = 0) -> Column:
    """Array of a pattern's matches in order. text must be free of OPEN and CLOSE.

    Each has its own length and that of the text up to the next one, in code points and in bytes, so that places are running
    sums: the work grows with the text, however many matches it has. lead and lead_b: the text before the first."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN, -1)

    def match(part: Column, i: Column, lead: Column, lead_b: Column) -> Column:
        hit = F.substring_index(part, CLOSE, 1)
        value = F.regexp_extract(hit, pattern, value_group) if value_group else hit
        chars, size = F.length(hit).cast("long"), F.octet_length(hit).cast("long")
        return F.struct(
            F.lit(kind_no).alias("kind_no"), i.cast("long").alias("i"), lead.alias("lead"), lead_b.alias("lead_b"),
            chars.alias("chars"), size.alias("bytes"), (F.length(part) - chars - 1).cast("long").alias("rest"), (F.octet_length(part) - size - len(CLOSE.encode())).cast("long").alias("rest_b"), value.alias("value"),
        )

    def of(p: Column) -> Column:
        # worked out once a text, not once a match
        ahead = F.struct(F.length(F.get(p, 0)).cast("long").alias("chars"), F.octet_length(F.get(p, 0)).cast("long").alias("bytes"))
        return let(ahead, lambda x: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda part, i: match(part, i, x["chars"], x["bytes"])))

    return let(parts, of)


def _clean(text: Column) -> Column:
    """The text without OPEN and CLOSE; what stands for them is as long, in code points and in bytes."""
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)


def all_matches(text: Column) -> Column:
    """Matches of the base kinds, and candidates (kind 3): an array of struct(kind_no, i, lead, lead_b, chars, bytes, rest, rest_b, hash, drop).

    drop: one that fails, but counts for the places of those after it."""
    clean = _clean(text)
    found = F.concat(_matches(clean, 0, PATTERNS["assign"], 2), _matches(clean, 1, PATTERNS["access"]), _matches(clean, 2, PATTERNS["hex"]), _matches(clean, 3, CANDIDATE))

    def judged(m: Column) -> Column:
        value = m["value"]
        short = (m["kind_no"] == 0) & (F.length(value) < 6)
        plain = (m["kind_no"] == 3) & ~(value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]"))
        return m.withField("hash", F.sha2(value, 256)).withField("drop", short | plain).dropFields("value")

    return F.transform(found, judged)


def _placed(each: DataFrame) -> DataFrame:
    """Spans of the matches of each row: row_, kind_no, start, stop, start_b, stop_b and the other columns; candidates that overlap a base span are gone."""
    same = Window.partitionBy("row_", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda a, b: F.coalesce(F.sum(F.col(a) + F.col(b)).over(same), F.lit(0))
    rows = each.withColumns({"start": F.col("lead") + before("chars", "rest"), "start_b": F.col("lead_b") + before("bytes", "rest_b")})
    rows = rows.withColumns({"stop": F.col("start") + F.col("chars"), "stop_b": F.col("start_b") + F.col("bytes")})
    rows = rows.where("not drop").drop("i", "lead", "lead_b", "chars", "bytes", "rest", "rest_b", "drop")
    # in order of their places: how far base spans before a candidate reach, and where those behind it begin
    base = F.col("kind_no") < 3
    ahead = Window.partitionBy("row_").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row_").orderBy(F.col("start").desc(), F.col("kind_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reach_", F.max(F.when(base, F.col("stop"))).over(ahead)).withColumn("next_", F.min(F.when(base, F.col("start"))).over(behind))
    # none begins where a candidate does and before it in this order but base spans
    clear = F.coalesce(F.col("reach_") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next_") >= F.col("stop"), F.lit(True))
    return rows.where(base | clear).drop("reach_", "next_")


def _kind(no: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in (*KINDS, "owned"))), no + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def weighed_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", min_owners: int = 3, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Two tables. The rows, saved: row_ (a key of each), doc_id, the columns of keep, and some_ (whether the row may have spans); and their spans: row_, kind_no, start, stop (code points), start_b, stop_b (bytes), copied."""
    has = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, has(owner_col).alias("owner_"), has(repo_col).alias("repo_"), text_or_empty(text_col).alias("text_"))
    # one pass over the texts; what is written has lengths, hashes and the columns of keep
    found = scratch.save(rows.withColumn("all_", all_matches(F.col("text_"))).drop("text_").withColumn("row_", F.monotonically_increasing_id()), "matches")

    # dealt by row once, as all windows go by rows; what stays in a text's row is its own
    each = found.where(F.size("all_") > 0).select("row_", "owner_", "repo_", F.inline("all_"))
    spans = _placed(each.repartition("row_"))
    # first distinct (hash, owner, repository), so that a hash in a third of all rows is small before it meets itself
    held = spans.select("hash", "owner_", "repo_").distinct()
    # a null owner or repository is one of its own; one column that is both is counted once
    owners = F.count_distinct(F.struct("owner_"))
    held_by = owners if owner_col == repo_col else F.greatest(owners, F.count_distinct(F.struct("repo_")))
    examples = scratch.save(held.groupBy("hash").agg(held_by.alias("n")).where(F.col("n") >= min_owners).select("hash", F.lit(True).alias("copied")), "examples")
    # both sides of the join are plain shuffles, so that a hot key can be split
    weighed = spans.join(dealt(examples), "hash", "left").select("row_", "kind_no", "start", "stop", "start_b", "stop_b", F.col("copied").isNotNull().alias("copied"))
    return found.withColumn("some_", F.size("all_") > 0).drop("all_", "owner_", "repo_"), weighed


def scan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", min_owners: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns of keep, base and added: sorted arrays of struct(start, kind_no, stop), n_live, n_example."""
    rows, spans = weighed_spans(docs, scratch, id_col, text_col, owner_col, repo_col, min_owners, keep)
    span, base = F.struct("start", "kind_no", "stop"), F.col("kind_no") < 3
    own = spans.groupBy("row_").agg(
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(~base & ~F.col("copied"), span))).alias("added"),
        F.count_if(~F.col("copied")).alias("n_live"),
        F.count_if("copied").alias("n_example"),
    )
    none = F.array().cast("array<struct<start: long, kind_no: int, stop: long>>")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(own, "row_", "left").select("doc_id", *keep, F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"), count("n_live"), count("n_example"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example."""
    found = scan(docs, Scratch(docs.sparkSession, "secrets"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_owned"),
        "n_live",
        "n_example",
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", owner_col: str = "source", repo_col: str = "source") -> DataFrame:
    """The table with every base and owned span replaced by mask; overlapping spans are masked as one. No row goes."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("original"), "doc_id", "text", has(owner_col).alias("owner"), has(repo_col).alias("repo"))
    found, spans = weighed_spans(rows, Scratch(docs.sparkSession, "redact"), owner_col="owner", repo_col="repo", keep=("original",))
    spans = spans.where("kind_no < 3 or not copied").select("row_", "start_b", "stop_b")
    # spans that overlap become one
    order = Window.partitionBy("row_").orderBy("start_b", "stop_b")
    before = F.max("stop_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start_b") >= F.col("before_"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    masks = spans.withColumn("before_", before).withColumn("group_", group).groupBy("row_", "group_").agg(F.min("start_b").alias("a"), F.max("stop_b").alias("b"))
    masks = masks.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("masks"))
    # what is between them, cut from the bytes, so that each piece costs its own length
    def cut(x: Column) -> Column:
        n = F.size(x["masks"])
        first = lambda i: F.when(i > 0, F.get(x["masks"], i - 1)["b"]).otherwise(F.lit(0))
        last = lambda i: F.when(i < n, F.get(x["masks"], i)["a"]).otherwise(F.length(x["data"]))
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(x["data"], (first(i) + 1).cast("int"), (last(i) - first(i)).cast("int")).cast("string"))

    between = let(F.struct(F.col("original.text").cast("binary").alias("data"), F.col("masks").alias("masks")), cut)
    hit = F.col("masks").isNotNull()
    # a row without matches goes past the join, so that few texts are shuffled
    out = found.where("some_").join(masks, "row_", "left").unionByName(found.where("not some_").withColumn("masks", F.lit(None).cast(masks.schema["masks"].dataType)))
    out = out.select("original", F.when(hit, F.array_join(between, mask)).otherwise(F.col("original.text")).alias("clean"), hit.alias("hit"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("clean").alias("text")
        if c == "n_chars":
            return F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(F.col("original.n_chars")).alias("n_chars")
        return F.col(f"original.`{c}`")

    return out.select(*(column(c) for c in docs.columns))

"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words, in SQL functions alone.

Sections are parted by an empty line, paragraphs by a line end. A paragraph's children are
its runs: up to eight words with the space before them, fewer where a sentence ends; what is left of
its white space is a run too, so the runs of a paragraph make up the whole of it. A run's
hash is the SHA-256 of its text, and every node above has the SHA-256 of its children's hashes, so
roots are equal exactly for equal texts, and an edit changes the runs it touches and the branches above
them. The string form is ``root:section[paragraph(run run ...),...]/...`` with 16 hex digits of the hashes of
sections and paragraphs and 8 of those of runs.

Two fingerprints are compared from the top: equal sections are not looked into, of differing
sections equal paragraphs are not, and of differing paragraphs the runs are compared.
Likeness is twice the distinct runs under what is equal over the runs of both, so an
edit costs the runs it touches; where a thing stands does not matter. Texts without words are alike only if
their roots are equal. `changed` gives the paragraphs in which a text differs.

Null texts are empty. Rows without an id come last in order of id; rows of one id are in order of a hash of
their text, then of its root. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import id_ranges

#: Up to eight words of one line with the space before each, fewer if a sentence ends; or space at a line's end.
RUN = r"[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09\x0B-\x0D]+){0,7}[^\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]+"
BRANCH_HEX, RUN_HEX = 16, 8
RANGE_BYTES, LEAST_RANGE = 64 << 20, 1 << 20


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column) -> Column:
    """The string form of a text's tree."""
    join, short = (lambda hashes: F.sha2(F.array_join(hashes, ""), 256)), (lambda h, n: F.substring(h, 1, n))
    leaves = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), F.lit(0)), lambda r: F.sha2(r, 256))))
    paragraphs = F.transform(leaves, lambda s: F.transform(s, lambda p: F.struct(join(p).alias("hash"), F.array_join(F.transform(p, lambda r: short(r, RUN_HEX)), " ").alias("runs"))))
    said = lambda p: F.concat(short(p["hash"], BRANCH_HEX), F.lit("("), p["runs"], F.lit(")"))
    sections = F.transform(paragraphs, lambda s: F.struct(join(F.transform(s, lambda p: p["hash"])).alias("hash"), F.array_join(F.transform(s, said), ",").alias("paragraphs")))
    branch = lambda s: F.concat(short(s["hash"], BRANCH_HEX), F.lit("["), s["paragraphs"], F.lit("]"))
    return with_value(sections, lambda a: F.concat(join(F.transform(a, lambda s: s["hash"])), F.lit(":"), F.array_join(F.transform(a, branch), "/")))


def root(of: Column) -> Column:
    return F.split_part(of, F.lit(":"), F.lit(1))


def sections(of: Column) -> Column:
    """The sections of a fingerprint, each with its branches."""
    return F.split(F.split_part(of, F.lit(":"), F.lit(2)), "/")


def _inside(branch: Column) -> Column:
    return F.substr(branch, F.lit(BRANCH_HEX + 2), F.length(branch) - (BRANCH_HEX + 2))


def paragraphs(of: Column) -> Column:
    """The paragraphs of some sections."""
    return F.flatten(F.transform(of, lambda s: F.split(_inside(s), ",")))


def runs(of: Column) -> Column:
    """The runs of some paragraphs."""
    return F.filter(F.flatten(F.transform(of, lambda p: F.split(_inside(p), " "))), lambda r: r != "")


def _weight(of: Column) -> Column:
    """How many runs some paragraphs have."""
    return F.aggregate(F.transform(of, lambda p: F.floor((F.length(p) - (BRANCH_HEX + 2) + 1) / (RUN_HEX + 1)).cast("int")), F.lit(0), lambda n, k: n + k)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, by a walk down both fingerprints."""

    def below(x: Column) -> Column:
        left, right = paragraphs(F.array_except(x["a"], x["b"])), paragraphs(F.array_except(x["b"], x["a"]))
        return with_value(F.struct(F.array_distinct(paragraphs(F.array_intersect(x["a"], x["b"]))).alias("same"), left.alias("a"), right.alias("b")), leaves)

    def leaves(y: Column) -> Column:
        same = _weight(y["same"]) + _weight(F.array_intersect(y["a"], y["b"]))
        left, right = F.array_distinct(runs(F.array_except(y["a"], y["b"]))), F.array_distinct(runs(F.array_except(y["b"], y["a"])))
        return with_value(F.struct(same.alias("same"), left.alias("a"), right.alias("b")), share)

    def share(z: Column) -> Column:
        both = 2 * z["same"] + F.size(z["a"]) + F.size(z["b"])
        return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * (z["same"] + F.size(F.array_intersect(z["a"], z["b"]))) / both)

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(with_value(F.struct(sections(a).alias("a"), sections(b).alias("b")), below))


def changed(a: Column, b: Column) -> Column:
    """Where b has paragraphs that a has not: section and paragraph (from 0) and the runs that are new there."""

    def numbered(of: Column) -> Column:
        return F.transform(of, lambda x, i: F.struct(i.alias("at"), x.alias("branch")))

    def in_sections(x: Column) -> Column:
        new = F.filter(numbered(x["b"]), lambda s: F.array_contains(F.array_except(x["b"], x["a"]), s["branch"]))
        old = paragraphs(F.array_except(x["a"], x["b"]))
        return with_value(F.struct(new.alias("new"), old.alias("old")), in_paragraphs)

    def in_paragraphs(y: Column) -> Column:
        def of(s: Column) -> Column:
            own = F.filter(numbered(F.split(_inside(s["branch"]), ",")), lambda p: ~F.array_contains(y["old"], p["branch"]))
            return F.transform(own, lambda p: F.struct(s["at"].alias("section"), p["at"].alias("paragraph"), F.array_except(runs(F.array(p["branch"])), runs(y["old"])).alias("runs")))

        return F.flatten(F.transform(y["new"], of))

    return with_value(F.struct(sections(a).alias("a"), sections(b).alias("b")), in_sections)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with tree (the fingerprint), next_text and next_tree, in descending order of id and round from the last to the first.

    Documents are dealt to ranges of ids; each range also gets, as a guest, the first
    document of the range after it, so that no range waits for another. What reaches the driver is a row for each
    RANGE_BYTES of text.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = id_ranges(docs, "doc_id", max(1, -(-size // RANGE_BYTES), min(tasks, size // LEAST_RANGE)))
    text_hash, last = F.xxhash64("text"), F.sha2("text", 256)
    number = ranges.of(F.col("doc_id"), text_hash)
    # the highest range comes first; rows without an id come after the lowest range
    at = F.when(F.col("doc_id").isNull(), F.lit(ranges.with_id + ranges.n - 1) - number).otherwise(F.lit(ranges.with_id - 1) - number)
    own = docs.select("doc_id", "text", text_hash.alias("text_hash"), at.alias("at"), F.lit(False).alias("guest"))
    order = F.struct(F.coalesce("doc_id", F.lit(0)), "text_hash", last)
    heads = own.groupBy("at").agg(F.max_by(F.struct("doc_id", "text_hash", last.alias("root")), order).alias("head")).orderBy("at").collect()  # a row a range
    firsts = [(heads[i - 1]["at"], *r["head"]) for i, r in enumerate(heads)]
    hosts = F.broadcast(docs.sparkSession.createDataFrame(firsts, "host int, head_id long, head_hash long, head_root string"))  # a row a range
    met = docs["doc_id"].eqNullSafe(hosts["head_id"]) & (text_hash == F.col("head_hash")) & (last == F.col("head_root"))
    guests = docs.join(hosts, met).select("doc_id", "text", F.col("head_hash").alias("text_hash"), F.col("host").alias("at"), F.lit(True).alias("guest")).dropDuplicates(["at"])
    w = Window.partitionBy("at").orderBy(F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc(), last.desc())
    ranged = own.unionByName(guests).repartition("at").withColumn("tree", fingerprint(F.col("text")))
    return ranged.withColumns({"next_text": F.lead("text").over(w), "next_tree": F.lead("tree").over(w)}).where(~F.col("guest")).drop("at", "guest", "text_hash")


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points replaced by the first as many (or all) of another text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = with_next(rows).withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_tree", fingerprint(F.col("edited")))
    near = {"near_edited": likeness(F.col("tree"), F.col("edited_tree")), "near_next": likeness(F.col("tree"), F.col("next_tree"))}
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("tree").alias("fingerprint"), F.col("edited_tree").alias("edited_fingerprint"), *(c.alias(k) for k, c in near.items()))

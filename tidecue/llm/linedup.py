"""Line dedup: an exact set-similarity join between lines, in DataFrame functions only.

A line is its set of lower-cased words. A line is removed if an earlier line (smaller document id, then
smaller line number) has a Jaccard similarity of at least ``percent``/100 with it.

1. Lines with equal word sets form a class, known by two independent 64-bit digests of the sorted 64-bit hashes
   of the words; all but the first of a class are removed, and from here on only the first lines are looked at.
   A class key is aggregated before the shuffle, so a line that half of the corpus repeats costs nothing. Lines
   of so few words that only equal sets are similar enough are done with.
2. The words of a line are ordered by rarity, and the first n - ceil(t n) + 1 of n words are its prefix:
   two lines that are similar enough share a word of their prefixes. Rarity comes from the lines that each word
   is in, over all documents, gathered in 65,536 hash buckets, so that the order is a constant of bounded size. Any
   order is right; with more words than buckets, rare words share counts, but a frequent word still outweighs its
   bucket and comes late. Words are told apart by 64-bit hashes. Texts are split into words once, for steps 1 and 2:
   the hashes of each line's words are written, and deleted when the prefixes are.
3. Two lines that share a prefix word must also pass the length filter, the positional filter, and a
   filter by parity sketches: 64 bits, each the parity of the words that hash to it; two sets differ in at
   least as many words as their sketches differ in bits. All three hold for every similar pair, so nothing
   is lost. Filters are part of the join condition: pairs that fail are never emitted.
4. First each line is compared with the earliest line of each of its words' lists, which settles most of a
   large group of near copies in a number of pairs that is linear in its size; only lines that are still
   unsettled meet the rest of their lists. Lists are joined with themselves over one exchange, and adaptive
   execution splits those of hot words.
5. Pairs are verified on the words themselves, which are split from the texts again: lines are written
   without their text.

Nulls and empty texts have no lines to remove; blank lines always stay. Rows that repeat an id and its text
count as one document. Rows without an id, and rows whose id stands for several texts, take no part and keep
their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import counted, settle, tidy, unused

PERCENT = 90
BUCKETS = 1 << 16
#: Rows of ids and line numbers, or of class keys, that may be broadcast; beyond it, a shuffle join takes them.
BROADCAST_ROWS = 500_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def _split(line: Column) -> Column:
    """The words of a line, with empty ones; by a single character where that is all there is."""
    odd = [F.contains(line, F.lit(x)) for x in "\t\x0b\x0c\r"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.split(line, _SPACE)).otherwise(F.split(line, " "))


def words(line: Column) -> Column:
    """The distinct words of a line."""
    return F.array_remove(F.array_distinct(_split(line)), "")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 48).cast("int")


def rarity(hashes: DataFrame, column: str = "h") -> Column:
    """A constant array: for each bucket of hashes, the change of bits that puts its place in order of count instead of its number."""
    counts = hashes.select(F.explode(column).alias("h")).groupBy(_bucket(F.col("h")).alias("b")).count()
    found = [0] * BUCKETS
    for b, c in counts.collect():  # at most BUCKETS rows
        found[b] = c
    changes = [0] * BUCKETS
    for at, b in enumerate(sorted(range(BUCKETS), key=found.__getitem__)):
        # as signed numbers of 16 bits: the first place is the smallest one
        changes[b] = ((b - BUCKETS if b >= BUCKETS // 2 else b) ^ (at - BUCKETS // 2)) << 48
    return F.split(F.lit(",".join(map(str, changes))), ",").cast("array<long>")


def single_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc and text of the rows that take part: those of ids that stand for one text."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    repeated = settle(docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).count().where("count > 1").select("doc"), "repeated-ids")
    if repeated.isEmpty():
        return rows
    several = rows.join(counted(repeated, BROADCAST_ROWS), "doc", "left_semi").select("doc", F.xxhash64("text").alias("h"))
    several = settle(several.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("doc"), "several-texts")
    return rows.join(counted(several, BROADCAST_ROWS), "doc", "left_anti")


@tidy("lines")
def split_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per line of (doc, text): doc, line number, number of words n, class key k1 and k2, parity sketch and prefix."""
    n = F.size("h")
    prefix = F.when(n * (100 - percent) >= percent, n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1).otherwise(0)
    lines = docs.select("doc", F.posexplode(F.split(F.lower("text"), "\n")).alias("no", "line"))
    # hashes are a step of their own, so that each is computed once
    hashes = F.array_distinct(F.transform(_split(F.col("line")), lambda x: F.xxhash64(x)))
    hashed = lines.select("doc", "no", F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit("")))).alias("h"))
    hashed = hashed.select("doc", "no", n.alias("n"), F.xxhash64("h").alias("k1"), F.xxhash64(F.lit(7), "h").alias("k2"), F.when(prefix > 0, F.col("h")).alias("h"))
    hashed = settle(hashed, "line-hashes")  # texts are split once; it goes when the prefixes are written
    ranks = rarity(hashed)
    # codes sort by rarity, and there is one for each hash; never null, and said to be so: such arrays are sorted as plain numbers
    codes = F.transform("h", lambda h: F.coalesce(F.get(ranks, _bucket(h)).bitwiseXOR(h), F.lit(0).cast("long")))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    parity = F.aggregate("h", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))
    return hashed.select("doc", "no", "n", "k1", "k2", parity.alias("sketch"), F.slice(F.sort_array(codes), F.lit(1), prefix).alias("prefix"))


def _may_match(a: str, b: str, percent: int) -> Column:
    """The filters that every pair of similar lines with a common prefix word passes."""
    c = F.col
    total = c(f"{a}n") + c(f"{b}n")
    need = F.ceil(total * F.lit(percent) / (100 + percent)).cast("int")
    left = F.least(c(f"{a}n") - c(f"{a}at"), c(f"{b}n") - c(f"{b}at"))  # words from this one on
    before = F.least(c(f"{a}at"), c(f"{b}at"))  # words before it that both may share
    length = F.least(c(f"{a}n"), c(f"{b}n")) * 100 >= F.greatest(c(f"{a}n"), c(f"{b}n")) * percent
    return length & (before + left >= need) & (F.bit_count(c(f"{a}sketch").bitwiseXOR(c(f"{b}sketch"))) <= total - 2 * need)


def _similar_later(a: DataFrame, b: DataFrame, percent: int) -> DataFrame:
    """Pairs (adoc, ano, bdoc, bno) of two frames of places that pass the filters; the second line is later."""
    c = F.col
    columns = ("doc", "no", "n", "at", "sketch")
    left, right = (df.select("word", *[c(x).alias(p + x) for x in [*columns, *(["open"] if "open" in df.columns else [])]]) for df, p in ((a, "a"), (b, "b")))
    later = (c("adoc") < c("bdoc")) | ((c("adoc") == c("bdoc")) & (c("ano") < c("bno")))
    # both sides name every column, so that a frame joined with itself is one exchange; the second line must be open
    joined = left.join(right, "word").where(later & _may_match("a", "b", percent))
    return (joined.where((c("aopen") + 2 * c("bopen")) >= 2) if "open" in a.columns else joined).select("adoc", "ano", "bdoc", "bno")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc, no) of pairs that are similar on their words."""
    pairs = settle(pairs.distinct(), "line-pairs")
    ids = pairs.select(F.col("adoc").alias("doc"), F.col("ano").alias("no")).union(pairs.select("bdoc", "bno")).distinct()
    wanted = settle(ids.groupBy("doc").agg(F.collect_list("no").alias("nos")), "line-ids")
    # lines are a column of their own and are used twice: inside the lambda alone, the text would be split for each of them
    found = docs.join(counted(wanted, BROADCAST_ROWS), "doc").select("doc", "nos", F.split(F.lower("text"), "\n").alias("lines"))
    found = found.select("doc", F.explode(F.transform("nos", lambda i: F.when(i < F.size("lines"), F.struct(i.alias("no"), F.get("lines", i).alias("line"))))).alias("x"))
    sets = settle(found.select("doc", "x.no", words(F.col("x.line")).alias("w")).dropDuplicates(["doc", "no"]), "line-sets")
    both = pairs.join(sets.toDF("adoc", "ano", "aw"), ["adoc", "ano"]).join(sets.toDF("bdoc", "bno", "bw"), ["bdoc", "bno"])
    common = F.size(F.array_intersect("aw", "bw"))
    similar = both.where(common * 100 >= (F.size("aw") + F.size("bw") - common) * percent)
    return settle(similar.select(F.col("bdoc").alias("doc"), F.col("bno").alias("no")).distinct(), "line-matches")


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All lines of (doc, text): doc, no, and whether the line is removed."""
    c = F.col
    lines = split_lines(docs, percent)
    classes = lines.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc", "no")).alias("f"), F.count("*").alias("c")).where("c > 1")
    classes = settle(classes.select("k1", "k2", c("f.doc").alias("fdoc"), c("f.no").alias("fno")), "line-classes")
    repeats = c("fdoc").isNotNull() & ((c("fdoc") != c("doc")) | (c("fno") != c("no")))
    marked = lines.join(counted(classes, BROADCAST_ROWS), ["k1", "k2"], "left").withColumn("repeats", repeats)
    first = marked.where("prefix is not null and not repeats")
    places = lambda df, *more: df.select("doc", "no", "n", "sketch", *more, F.posexplode("prefix").alias("at", "word"))
    row = F.struct("doc", "no", "n", "at", "sketch")
    leaders = places(first).groupBy("word").agg(F.count("*").alias("c"), F.min(row).alias("f")).where("c > 1").select("word", "f.*")
    settled = _verified(_similar_later(leaders, places(first), percent), docs, percent)
    still = settled.withColumn("done", F.lit(True))
    lists = places(first.join(counted(still, BROADCAST_ROWS), ["doc", "no"], "left").withColumn("open", c("done").isNull().cast("int")), "open")
    matches = settled.union(_verified(_similar_later(lists, lists, percent), docs, percent)).withColumn("matched", F.lit(True))
    found = marked.join(counted(matches, BROADCAST_ROWS), ["doc", "no"], "left")
    return found.select("doc", "no", (c("repeats") | c("matched").isNotNull()).alias("removed"))


@tidy("line-counts")
def line_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document with lines: its number of lines, of removed lines, and the numbers of the removed ones (from 0)."""
    lines = removed_lines(single_texts(docs, key, text), percent)
    gone = F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("no"))))
    counts = lines.groupBy("doc").agg((F.max("no") + 1).cast("long").alias("n_lines"), gone.alias("removed"))
    return counts.select(F.col("doc").alias(key), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def remove_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents without their removed lines, all columns kept; documents left without text stay, empty."""
    doc, removed, lines = unused("doc", docs), unused("removed", docs), unused("lines", docs)
    gone = line_counts(docs, key, text, percent).where("n_removed > 0").select(F.col(key).alias(doc), F.col("removed").alias(removed))
    joined = docs.join(counted(gone, BROADCAST_ROWS), F.col(key) == F.col(doc), "left")  # few: texts are not shuffled
    joined = joined.withColumn(lines, F.when(F.col(removed).isNotNull(), F.split(F.col(text), "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(rest)).select(docs.columns)

"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become templates: numbers, names and units turn into typed placeholders, other words are lower-cased
without the marks at their end. Windows of ``window`` templates are hashed and joined with the windows of
the benchmark items. Runs of matching windows at the same offset form an occurrence; it counts if its slots
are consistent, so that every value of the item stands for one value in the document (two values of the item may
become one, as numbers drawn anew often do). A document is
contaminated by an item if its consistent occurrences cover at least ``share`` of the item's windows, even
if numbers and names were exchanged.

An item without any window that has enough literals is looked for as a whole: its words in lower case, or its
templates if one of them is literal and its slots are consistent. Such an item counts as one window. It is found
by the hash of its anchor, up to ``window`` words of it, and then compared word for word. The first word of an
item has no word before it, so a capital may make it a name or not; it is taken both ways.

Documents are only mapped to (document, place, hash) rows; the benchmark side is broadcast while its size,
which is counted first, allows it, and is joined by hash otherwise. Words are fetched again only for
documents that matched a window with slots. Nulls and blank texts match nothing; rows without id
take no part; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import counted, settle, tidy

WINDOW = 8
#: A window must have this many words that are not placeholders.
LITERALS = 5
SHARE = 0.2
HOLDERS = ("<number>", "<unit>", "<name>")
#: Benchmark windows that may be broadcast: about 100 bytes each.
BROADCAST_WINDOWS = 300_000
#: Ids of documents with slots that may be broadcast; beyond it, a shuffle join fetches their texts.
BROADCAST_IDS = 1_000_000
_SPACE = "[\\x20\\x09-\\x0D]+"
_EDGE = " \t\n\x0b\x0c\r"
_MARKS = ".,;:!?\"')"
#: Fixed word lists of the templates: number words and units in English, German, French and Spanish. Words that are
#: also articles or other common words in one of these (ein, un, elf, neuf, null, once) are left out.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
    "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "zwölf", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig", "hundert", "tausend",
    "zéro", "deux", "trois", "quatre", "cinq", "sept", "huit", "dix", "onze", "douze", "vingt", "trente", "quarante", "cinquante", "soixante", "cent", "mille",
    "cero", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "doce", "veinte", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "mil",
]
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "feet", "miles", "mg", "g", "kg", "grams", "pounds", "tons", "ml", "l", "liters", "litres", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "mph", "km/h", "dollars", "euros", "cents", "percent", "degrees", "meters", "metres", "kilometers", "kilograms", "watts", "volts",
    "zoll", "fuß", "meilen", "meter", "kilometer", "gramm", "kilogramm", "pfund", "tonnen", "liter", "sekunden", "minuten", "stunden", "tage", "wochen", "monate", "jahre", "dollar", "euro", "prozent", "grad",
    "pouces", "pieds", "mètres", "kilomètres", "grammes", "kilogrammes", "tonnes", "heures", "jours", "semaines", "mois", "pourcent", "degrés",
    "pulgadas", "pies", "millas", "metros", "kilómetros", "gramos", "kilogramos", "libras", "toneladas", "litros", "segundos", "minutos", "horas", "días", "semanas", "meses", "años", "dólares", "grados",
]


def words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(_EDGE)), _SPACE)


def plain(word: Column) -> Column:
    """A word in lower case without the marks at its end."""
    return F.lower(F.rtrim(word, F.lit(_MARKS)))


def template(word: Column, before: Column) -> Column:
    """The template of a word, given the word before it (null at the start of a text).

    A name is a word with a capital first letter, all others small, that does not start a sentence.
    """
    p = plain(word)
    first = F.substring(word, 1, 1)
    # most words fail one look-up and two tests of the first character, and meet no pattern
    number = (first < ":") & p.rlike("^[-+$]?[0-9][0-9.,]*(%|st|nd|rd|th)?$")
    name = first.between("A", "Z") & before.isNotNull() & ~before.rlike("[.!?:]$") & word.rlike("^[A-Z][a-z]+[.,;:!?\"')]*$")
    listed = F.when(p.isin(UNITS), "<unit>").otherwise("<number>")
    return F.when(p.isin(*NUMBER_WORDS, *UNITS), listed).when(number, "<number>").when(name, "<name>").otherwise(p)


def may_be_name(word: Column) -> Column:
    """Whether a word would be a name if it did not start a sentence."""
    return word.rlike("^[A-Z][a-z]+[.,;:!?\"')]*$") & ~plain(word).isin(*NUMBER_WORDS, *UNITS)


def windows(hashed: Column, size: int) -> Column:
    """The hash of every window of an array of hashes."""
    n = F.size(hashed) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashed, i, F.lit(size)))))


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """Items, their words w, the same plain (p), and their templates: a list of one form, or of two if the first word may be a name."""
    items = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), words(F.col(text)).alias("w")).distinct()
    items = items.select("item", "w", F.transform("w", plain).alias("p"), F.transform("w", lambda w, i: template(w, F.get("w", i - 1))).alias("t"))
    named = F.concat(F.array(F.lit("<name>")), F.slice("t", F.lit(2), F.size("t") - 1))
    return items.select("item", "w", "p", "t", F.when(may_be_name(F.get("w", F.lit(0))), F.array("t", named)).otherwise(F.array("t")).alias("forms"))


def _count(templates: Column, marked: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(templates, marked))


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """Windows of the items: item, its number of windows, place, hash, and its slots (offset, value).

    The first window has a second form, in which the first word is a name, where that window alone can decide.
    """
    items = _items(benchmark, key, text).select("item", "w", F.posexplode("forms").alias("form", "t")).withColumn("h", F.transform("t", lambda x: F.xxhash64(x)))
    rows = items.select("item", "w", "t", "form", F.posexplode(windows(F.col("h"), window)).alias("at", "hash")).where("form = 0 or at = 0")
    own = F.slice("t", F.col("at") + 1, F.lit(window))
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.when(F.get("t", F.col("at") + k).isin(*HOLDERS), F.struct(k.alias("offset"), plain(F.get("w", F.col("at") + k)).alias("value")))), lambda s: s.isNotNull())
    kept = rows.where(_count(own, lambda x: ~x.isin(*HOLDERS)) + F.col("form") >= literals).select("item", "at", "hash", slots.alias("slots"), "form")
    sizes = kept.groupBy("item").agg(F.countDistinct("at").alias("item_windows"))
    n = F.col("item_windows")
    decides = (n * share <= 1) | (n - 1 < n * share)
    return settle(kept.join(sizes, "item").where((F.col("form") == 0) | decides).drop("form"), "benchmark-windows")


def benchmark_wholes(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Texts of items without any window: item, what to meet (own: plain words if exact, else templates), plain words, and the
    anchor: its place, size and hash. Of templates, the anchor is the window with the most literals."""
    literal = lambda x: ~x.isin(*HOLDERS, "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - window + 1))
    covered = (F.size("t") >= window) & F.exists(starts, lambda i: _count(F.slice("t", i, F.lit(window)), lambda x: ~x.isin(*HOLDERS)) >= literals)
    items = _items(benchmark, key, text).where(~covered & F.exists("p", lambda x: x != ""))
    ways = items.select("item", "p", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("exact"), F.col("p").alias("own"))), F.transform("forms", lambda t: F.struct(F.lit(False).alias("exact"), t.alias("own"))))).alias("x"))
    ways = ways.select("item", "p", "x.exact", "x.own").where(F.col("exact") | F.exists("own", literal))
    ways = ways.withColumn("size", F.least(F.size("own"), F.lit(window)))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("own") - F.col("size")), lambda i: F.struct(_count(F.slice("own", i + 1, F.col("size")), literal).alias("n"), (-i).alias("i"))))
    ways = ways.withColumn("at", -best["i"])
    hashed = F.when(F.col("exact"), F.transform("own", _exact)).otherwise(F.transform("own", lambda x: F.xxhash64(x)))
    return settle(ways.withColumn("hash", F.xxhash64(F.slice(hashed, F.col("at") + 1, F.col("size")))), "benchmark-wholes")


def _exact(word: Column) -> Column:
    """The hash of a plain word, apart from that of a template."""
    return F.xxhash64(F.lit("="), word)


def whole_items(docs: DataFrame, wholes: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Pairs of document and item that stands in it as a whole, and whether slot values were exchanged."""
    sided = counted(wholes, BROADCAST_WINDOWS)
    kinds = wholes.select("exact", "size").distinct().collect()  # two for each size up to the window's
    split = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), words(F.col(text)).alias("w"))
    hashed = split.select("doc", F.transform("w", lambda w, i: F.xxhash64(template(w, F.get("w", i - 1)))).alias("h"), F.transform("w", lambda w: _exact(plain(w))).alias("e"))
    places = hashed.select("doc", F.explode(F.array(*[windows(F.col("e" if k.exact else "h"), k["size"]) for k in kinds])).alias("x")).select("doc", F.posexplode("x").alias("place", "hash"))
    hits = places.join(sided, "hash").withColumn("start", F.col("place") - F.col("at")).where("start >= 0")
    # where the anchor is all there is to meet, one place says what all say
    all_seen = F.col("exact") & (F.size("own") <= window)
    hits = settle(hits.groupBy("doc", "item", "exact", "own", "p", F.when(~all_seen, F.col("start")).alias("apart")).agg(F.min("start").alias("start")), "whole-hits")
    wanted = counted(hits.select("doc").distinct(), BROADCAST_IDS)
    found = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).join(wanted, "doc", "left_semi").select("doc", words(F.col("t")).alias("w"))
    cut = hits.join(found, "doc").select("doc", "item", "exact", "own", "p", F.get("w", F.col("start") - 1).alias("before"), F.slice("w", F.col("start") + 1, F.size("own")).alias("d"))
    seen = F.when(F.col("exact"), F.transform("d", plain)).otherwise(F.transform("d", lambda w, i: template(w, F.when(i == 0, F.col("before")).otherwise(F.get("d", i - 1)))))
    slots = F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda k: F.when(~F.col("exact") & F.get("own", k).isin(*HOLDERS), F.struct(F.get("p", k).alias("value"), plain(F.get("d", k)).alias("own"))))
    met = cut.where(seen == F.col("own")).select("doc", "item", F.array_distinct(F.filter(slots, lambda s: s.isNotNull())).alias("s"))
    met = met.where(F.size("s") == F.size(F.array_distinct(F.transform("s", lambda s: s["value"]))))
    return met.groupBy("doc", "item").agg(F.max(F.exists("s", lambda s: s["value"] != s["own"])).alias("reparameterised"))


@tidy("contaminated")
def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", window: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """Pairs of document and item: n_windows matched, item_windows, and whether slot values were exchanged."""
    bench = benchmark_windows(benchmark, item_key, "text", window, literals, share)
    sided = counted(bench, BROADCAST_WINDOWS)
    # words are a column of their own: an expression inside the lambda would be split again for every word
    split = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), words(F.col(text)).alias("w"))
    hashed = split.select("doc", F.transform("w", lambda w, i: F.xxhash64(template(w, F.get("w", i - 1)))).alias("h"))
    places = hashed.select("doc", F.posexplode(windows(F.col("h"), window)).alias("place", "hash"))
    hits = places.join(sided, "hash").select("doc", "item", "item_windows", "at", "place", "slots").distinct()
    hits = settle(hits.withColumn("run", F.col("place") - F.col("at")), "window-hits")
    slotted = hits.where(F.size("slots") > 0).select("doc", "item", "run", "place", F.explode("slots").alias("s")).select("doc", "item", "run", (F.col("place") + F.col("s.offset")).alias("at"), F.col("s.value").alias("value"))
    slotted = settle(slotted.distinct(), "window-slots")
    wanted = counted(slotted.select("doc").distinct(), BROADCAST_IDS)  # few: texts are not shuffled
    found = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).join(wanted, "doc", "left_semi").select("doc", words(F.col("t")).alias("w"))
    values = slotted.join(found, "doc").select("doc", "item", "run", "value", plain(F.get("w", F.col("at"))).alias("own"))
    slots = values.groupBy("doc", "item", "run", "value").agg(F.countDistinct("own").alias("n"), F.max(F.col("own") != F.col("value")).alias("other"))
    slots = slots.groupBy("doc", "item", "run").agg(F.max("n").alias("n"), F.max("other").alias("other"))
    good = hits.join(slots, ["doc", "item", "run"], "left").where("n is null or n = 1")
    pairs = good.groupBy("doc", "item", "item_windows", "at").agg(F.max(F.coalesce("other", F.lit(False))).alias("other"))
    pairs = pairs.groupBy("doc", "item", "item_windows").agg(F.count("*").alias("n_windows"), F.max("other").alias("reparameterised"))
    pairs = pairs.where(F.col("n_windows") >= F.col("item_windows") * share)
    wholes = benchmark_wholes(benchmark, item_key, "text", window, literals)
    if not wholes.isEmpty():
        pairs = settle(pairs, "window-pairs")
        met = whole_items(docs, wholes, key, text, window).join(pairs, ["doc", "item"], "left_anti")
        one = F.lit(1).cast("long")
        pairs = pairs.unionByName(met.select("doc", "item", one.alias("item_windows"), one.alias("n_windows"), "reparameterised"))
    return pairs.select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_windows", "item_windows", "reparameterised")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that no item contaminates, all columns kept."""
    found = contaminated(docs, benchmark, key, **options).select(key).distinct()
    return docs.join(counted(found, BROADCAST_IDS), key, "left_anti").select(docs.columns)

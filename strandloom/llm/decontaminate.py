"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts become templates: capitalised words within a sentence are names, tokens that begin with a digit are numbers, and
a fixed list of words and the signs of percent and money are units; each gives way to a typed placeholder, the rest is
lower-cased and freed of punctuation. Signs are tokens of their own ('$4' is a unit and a number). Names that follow
each other ('New York') are one name, as are the parts of a number ('1,000', '3.5'). A capitalised word elsewhere (it
begins a sentence, say) has two readings, as the word and as a name; its windows are there in both. Windows of `window`
template tokens are hash-joined with those of the benchmark; a window that is all placeholders but one says nothing and
is left out. Matches are grouped by document, item and diagonal (the difference of positions). On a diagonal every slot
value of the item must stand for one value in the document, and every name in the document for one name of the item
(two numbers or units may become equal), else the agreement is by chance and the diagonal is dropped (down to the
reading without such names, if that one agrees; where both texts begin a sentence with the same word, it is no slot). A
document leaks an item if it has `threshold` or more of the item's windows on consistent diagonals, or, with `run`, if
any part of a diagonal that is `run` tokens long matches without a gap and is consistent in itself (it begins and ends
with a telling window), whatever part of the item it is: items of which a text quotes a part, or that the end of a text
cuts off, are leaks. find_leaks does without `run` unless told; op2 and the pipeline take RUN. Items with fewer tokens
than a window, and two words or more, are windows of their own length. Copies with other numbers, names or units are
caught as well as literal ones.

Templates are made only for documents that have one of the benchmark's keys (see _keys); all others can't leak enough
of any item by either rule.

Defined results: null and empty texts have no window and are clean; items with a null id or
without a telling window (two words, the rest placeholders) match nothing; rows that repeat an id are judged by their own text; null ids are reported as null;
an empty table on either side gives no leak; other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Words and signs that count as units of measure.
UNITS = (
    "mm cm dm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l "
    "liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week "
    "weeks month months year years mph kmh percent % $ € £ ¢ dollar dollars euro euros cent cents"
).split()
MARK, MAYBE, JOIN = "\x01", "\x02", "\x03"  # before a name, before what may be one, within a name or number of several parts
BROADCAST_BYTES = 64 << 20  # of windows of the benchmark that go to every task; beyond, both sides are dealt out by hash
BROADCAST_LEAKS = 1_000_000  # ids of leaking documents that go to every task
KEYS = 20_000
RUN = 13  # tokens: a part of an item that counts as a leak


def _marked(text: Column) -> Column:
    """Tokens with one space between, names and possible names marked; number, name and unit tokens still have their values."""
    text = F.translate(F.coalesce(text, F.lit("")), MARK + MAYBE + JOIN, "   ")
    names = F.regexp_replace(text, r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;] )", MARK)
    names = F.regexp_replace(names, rf"({MARK}[\p{{L}}\p{{N}}]+) (?={MARK})", f"$1{JOIN}")
    names = F.regexp_replace(names, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}{MARK}])", MAYBE)
    numbers = F.regexp_replace(names, r"(?<=\p{N})(?:[.,](?=\p{N})| (?=\p{N}{3}(?!\p{N})))", JOIN)
    signs = F.regexp_replace(F.lower(numbers), r"([%$€£¢])", " $1 ")
    plain = F.regexp_replace(signs, rf"[^\p{{L}}\p{{N}}{MARK}{MAYBE}{JOIN}%$€£¢]+", " ")
    return F.trim(plain)


def _template(marked: Column) -> Column:
    """Possible names stay marked."""
    named = F.regexp_replace(marked, rf"{MARK}[^ ]+", "<name>")
    numbered = F.regexp_replace(named, r"(?<![^ ])\p{N}[^ ]*", "<num>")
    units = "|".join(f"\\{u}" if len(u) == 1 and not u.isalpha() else u for u in UNITS)
    return F.regexp_replace(numbered, rf"(?<![^ ])({MAYBE}?)(?:{units})(?![^ ])", "$1<unit>")


def _windows(template: Column, window: int) -> Column:
    return F.regexp_extract_all(template, F.lit(rf"(?<![^ ])(?=((?:[^ ]+ ){{{window - 1}}}[^ ]+))"), F.lit(1))


def _readings(window: Column) -> Column:
    """(window, plain): possible names as words, and if there are any, as names, which isn't plain."""
    read = lambda w, plain: F.struct(w.alias("window"), F.lit(plain).alias("plain"))
    named = F.regexp_replace(window, rf"{MAYBE}[^ ]+", "<name>")
    return F.when(window.contains(MAYBE), F.array(read(F.translate(window, MAYBE, ""), True), read(named, False))).otherwise(F.array(read(window, True)))


def _telling(windowed: Column) -> Column:
    """At least two tokens are words."""
    return F.regexp_count(windowed, F.lit(r"<(?:name|num|unit)>")) <= F.size(F.split(windowed, " ")) - 2


def _keys(items: DataFrame, window: int, threshold: float, run: int | None, most: int) -> list[str] | None:
    """Words, or pairs of words with a space between that follow each other, of which every leaking document has one; None
    if there is no such list of at most `most`.

    A leak lacks at most a 1 - threshold part of an item's windows, so it has one of any larger part: of the windows with
    the longest keys, whose keys these are. Of two readings of a window, the one with fewer words counts. A leak by `run`
    has all windows of some stretch, so it has the longest key of all windows there."""
    word = lambda w: w.rlike(r"^\p{L}+$")
    tokens = F.split("window", " ")
    following = F.concat(F.slice(tokens, 2, F.size(tokens)), F.array(F.lit("")))
    size = lambda w: F.struct(F.length(w).alias("size"), w.alias("key"))
    both = F.filter(F.zip_with(tokens, following, lambda a, b: F.when(word(a) & word(b), size(F.concat(a, F.lit(" "), b)))), lambda k: k.isNotNull())
    longest = F.array_max(F.concat(both, F.transform(F.filter(tokens, word), size)))
    sized = items.groupBy("item_id", "item_key", "item_pos").agg(F.min_by("window", F.size(F.filter(tokens, word))).alias("window")).select("item_id", "item_key", "item_pos", longest.alias("k"))
    item = Window.partitionBy("item_id", "item_key")
    ranked = sized.select("k", F.row_number().over(item.orderBy(F.col("k.size").desc_nulls_last(), "k.key", "item_pos")).alias("r"), F.count("*").over(item).alias("n"))
    needed = ranked.filter(F.col("r") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1).select("k.key")
    if run is not None:
        stretch = item.orderBy("item_pos").rangeBetween(0, run - window)
        ends = sized.select(F.max("k").over(stretch).alias("k"), (F.max("item_pos").over(stretch) - F.col("item_pos")).alias("long"))
        needed = needed.unionByName(ends.filter(F.col("long") == run - window).select("k.key"))
    found = [r["key"] for r in needed.distinct().limit(most + 1).collect()]
    return None if len(found) > most or None in found else found


def _has_key(text: Column, keys: list[str]) -> Column:
    """One pass over the text's words, each with the word before it."""
    pairs = [k for k in keys if " " in k]
    words, firsts = [k for k in keys if " " not in k], sorted({k.split(" ")[0] for k in pairs})
    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("hit"))

    def step(acc: Column, w: Column) -> Column:
        pair = acc["before"].isin(firsts) & F.concat(acc["before"], F.lit(" "), w).isin(pairs)
        return F.struct(w.alias("before"), (acc["hit"] | pair | w.isin(words)).alias("hit"))

    return F.aggregate(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), start, step, lambda acc: acc["hit"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 5, threshold: float = 0.8, run: int | None = None, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, text_key (a hash of the text), item_id, n_matched, n_windows, containment, reworded (a slot differs). run: tokens, at least a window."""
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.xxhash64(item_text).alias("item_key"), _marked(F.col(item_text)).alias("marked"))
    raw = F.split("marked", " ")
    short = [r["n"] for r in items.select(F.size(raw).alias("n")).filter((F.col("n") > 1) & (F.col("n") < window)).distinct().collect()]  # a few numbers below `window`
    wide = lambda n: F.when(F.size(raw) == n, _windows(_template(F.col("marked")), n)).otherwise(F.array().cast("array<string>"))
    items = items.select("item_id", "item_key", raw.alias("raw"), F.posexplode(F.concat(_windows(_template(F.col("marked")), window), *map(wide, short))).alias("item_pos", "both"))
    items = items.withColumn("r", F.explode(_readings(F.col("both")))).select("item_id", "item_key", "raw", "item_pos", "r.window", F.col("r.plain").alias("item_plain")).filter(_telling(F.col("window")))
    items = items.select("item_id", "item_key", "item_pos", "window", "item_plain", F.xxhash64("window").alias("h"), F.slice("raw", F.col("item_pos") + 1, F.size(F.split("window", " "))).alias("item_values")).distinct()
    sizes = items.groupBy("item_id", "item_key").agg(F.countDistinct("item_pos").alias("n_windows"))

    keys = _keys(items, window, threshold, run, KEYS)
    if keys is not None:  # most documents have none of them and need no template
        docs = docs.filter(_has_key(F.col(text), keys) if keys else F.lit(False))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), _marked(F.col(text)).alias("marked"))
    template = _template(F.col("marked"))
    if short:
        at = F.flatten(F.array(*[F.transform(_windows(template, n), lambda w, k: F.struct(k.alias("pos"), w.alias("both"))) for n in (window, *short)]))
        flat = read.select("doc_id", "text_key", "marked", F.inline(at))
    else:
        flat = read.select("doc_id", "text_key", "marked", F.posexplode(_windows(template, window)).alias("pos", "both"))
    flat = flat.withColumn("r", F.explode(_readings(F.col("both")))).select("doc_id", "text_key", "marked", "pos", F.col("r.window").alias("found"), "r.plain", F.xxhash64("r.window").alias("h"))
    own = F.slice(F.split("marked", " "), F.col("pos") + 1, F.size(F.split("found", " ")))
    weight = items.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("item_values", " ")) + 100).alias("n")).first()["n"]
    if (weight or 0) <= BROADCAST_BYTES:  # the benchmark is small: it goes to the texts
        joined = flat.join(F.broadcast(items), "h").filter("found = window").withColumn("values", own)
    else:
        joined = flat.withColumn("values", own).drop("marked").join(items, "h").filter("found = window")
    slots = F.filter(
        F.arrays_zip(F.split("window", " ").alias("kind"), F.col("item_values").alias("x"), F.col("values").alias("y")), lambda z: z["kind"].isin("<name>", "<num>", "<unit>")
    )
    slots = F.filter(slots, lambda z: ~(z["x"].startswith(MAYBE) & (z["x"] == z["y"])))
    value = lambda v: F.translate(v, MAYBE, MARK)
    pairs = F.transform(slots, lambda z: F.struct(value(z["x"]).alias("x"), value(z["y"]).alias("y")))
    matched = joined.select("doc_id", "text_key", "item_id", "item_key", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), (F.col("plain") & F.col("item_plain")).alias("plain"), pairs.alias("slots"))
    matched = materialise(matched, "matched") if run is not None else matched  # both rules read it
    keys = ["doc_id", "text_key", "item_id", "item_key"]

    def agreed(rows: Column) -> Column:
        """Places and slot pairs of one diagonal's windows."""
        return F.struct(F.collect_set(F.when(rows, F.col("item_pos"))).alias("places"), F.array_distinct(F.flatten(F.collect_set(F.when(rows, F.col("slots"))))).alias("pairs"))

    def one_value(a: Column) -> Column:
        each = lambda pairs, side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))) == F.size(pairs)
        return each(a["pairs"], "x") & each(F.filter(a["pairs"], lambda p: p["x"].startswith(MARK)), "y")

    aligned = matched.groupBy(*keys, "diagonal").agg(agreed(F.lit(True)).alias("all"), agreed(F.col("plain")).alias("own"))  # at most an item's windows each
    sound = aligned.select(*keys, F.when(one_value(F.col("all")), F.col("all")).when(one_value(F.col("own")), F.col("own")).alias("a"), F.lit(False).alias("whole"))
    if run is not None:  # stretches of `run` tokens from each place
        ahead = Window.partitionBy(*keys, "diagonal").orderBy("item_pos").rangeBetween(0, run - window)
        near = matched.select(*keys, "item_pos", *[F.struct(F.collect_set(F.when(r, F.col("item_pos"))).over(ahead).alias("places"), F.array_distinct(F.flatten(F.collect_set(F.when(r, F.col("slots"))).over(ahead))).alias("pairs")).alias(name) for name, r in (("all", F.lit(True)), ("own", F.col("plain")))])

        def full(a: Column) -> Column:
            """The windows overlap or touch from the first token to the last, and agree."""
            reach = lambda to, at: F.when(at <= to, at + window).otherwise(to)
            return (F.aggregate(F.array_sort(a["places"]), F.col("item_pos"), reach) >= F.col("item_pos") + run) & one_value(a)

        stretches = near.select(*keys, F.when(full(F.col("all")), F.col("all")).when(full(F.col("own")), F.col("own")).alias("a"), F.lit(True).alias("whole"))
        sound = sound.unionByName(stretches)
    sound = sound.filter("a is not null").select(*keys, "whole", "a.*")
    changed = F.exists("pairs", lambda p: p["x"] != p["y"])
    places = sound.select(*keys, "whole", changed.alias("changed"), F.explode("places").alias("place")).groupBy(*keys, "place").agg(F.bool_and("changed").alias("changed"), F.bool_or("whole").alias("whole"))
    found = places.groupBy(*keys).agg(F.count("*").alias("n_matched"), F.bool_or("changed").alias("reworded"), F.bool_or("whole").alias("whole")).join(sizes, ["item_id", "item_key"])
    found = found.withColumn("containment", F.col("n_matched") / F.col("n_windows")).filter((F.col("containment") >= threshold) | F.col("whole"))
    return found.select("doc_id", "text_key", "item_id", "n_matched", "n_windows", "containment", "reworded")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", run: int | None = RUN, **how) -> DataFrame:
    """The rows of docs that leak no item, all columns. Texts stay where they are unless very many documents leak."""
    leaks = find_leaks(docs, benchmark, text=text, doc_id=doc_id, run=run, **how).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    leaks = materialise(leaks, "leaks")
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_LEAKS else leaks
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row")
    same = own.getField(doc_id).eqNullSafe(F.col("leak_id")) & (F.xxhash64(own.getField(text)) == F.col("leak_key"))
    return rows.join(leaks, same, "left_anti").select("row.*")

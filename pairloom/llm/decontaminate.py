"""Benchmark decontamination by template windows, in SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

# one character each, which no token holds
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"

# fixed values: number words; units that are units wherever they stand, and ones only after a number
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien"
).split()
UNITS = (
    "mm cm km inches yards mile miles mg kg grams kilogram kilograms lbs pounds ounce ounces ml liter liters litre "
    "litres seconds minutes hour hours days weeks months years dollar dollars cents euro euros percent degrees mph kph "
    "meters metres kilometer kilometers kilometre kilometres "
    "sekunde sekunden minuten stunde stunden tage tagen wochen monate monaten jahre jahren gramm kilogramm prozent "
    "seconde secondes heure heures jours semaines mois années mètre mètres kilomètre kilomètres gramme grammes "
    "segundos minutos hora horas días semanas meses años metro metros kilómetro kilómetros gramos litros"
).split()
UNITS_AFTER_NUMBER = (
    "m in inch ft feet foot yd mi g gram lb pound oz l s sec second min minute h hr day week month year cent meter metre "
    "tag woche monat jahr grad pfund jour semaine ans an livres segundo minuto día semana mes año gramo litro grados libras"
).split()
# capitalised words that are no names
OPENERS = (
    "a an the this that these those there here it he she they we you i my your his her its our their one if when while after before "
    "because since as at by for from in of on to with and or but so then thus how what which who whom whose why where is are was were "
    "do does did can could will would should has have had let suppose given find each every all some no not "
    "der die das den dem ein eine er sie es wir ich und oder wenn wie was wer wo warum ist sind hat haben "
    "le la les un une des il elle ils elles nous vous je et ou si quel quelle comment pourquoi est sont "
    "el los las una unos unas él ella ellos nosotros yo y o qué cuál cómo cuánto cuántos por es son"
).split()

TOKEN = r"[\p{L}\p{M}]++|\d++(?:[.,]\d++)*+"
# the same tokens, each with the marks before it if a sentence ends there
MARKED = r"(?:[.!?:\n][^\p{L}\p{M}\d]*+)?+(?:[\p{L}\p{M}]++|\d++(?:[.,]\d++)*+)"


@dataclass(frozen=True)
class TemplateParams:
    """window: tokens of a template window (an item with fewer tokens is one window of its length).
    min_literal: windows with fewer plain words can't be told from chance; an item without other windows is
    matched by its lower-cased tokens, verbatim. min_cover: share of an item's windows that a document
    must hold on one alignment or on ones up to ``drift`` tokens apart. broadcast_rows: benchmark windows up
    to this number are broadcast (about 60 bytes each); more are joined by a shuffle."""

    window: int = 8
    min_literal: int = 4
    min_cover: float = 0.5
    drift: int = 4
    broadcast_rows: int = 1_000_000


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def marked_classes(tokens: Column) -> Column:
    """Placeholder or lower-cased word for each token, joined by blanks. A name is a capitalised word that
    isn't one of ``OPENERS``; an ambiguous unit word is a unit right after a number only."""
    def one(t: Column) -> Column:
        first, low = F.ascii(t), F.lower(t)
        return (
            # most tokens: a word that begins with a-z and is no number or unit word
            F.when(first.between(97, 122) & ~low.isin(NUMBER_WORDS + UNITS), low)
            .when(first.between(48, 57) | low.isin(NUMBER_WORDS), NUMBER)
            .when(low.isin(UNITS), UNIT)
            .when((F.substring(t, 1, 1) != F.substring(low, 1, 1)) & ~low.isin(OPENERS), NAME)
            .otherwise(low)
        )

    return F.regexp_replace(F.array_join(F.transform(tokens, one), " "), f"{NUMBER} (?:{'|'.join(UNITS_AFTER_NUMBER)})(?= |$)", f"{NUMBER} {UNIT}")


def collapsed(classes: Column) -> Column:
    """Runs of placeholders of one kind become one: 'Tom' and 'Mary Ann', '25' and 'twenty five' fill one slot."""
    return F.regexp_replace(classes, f"([{NUMBER}{NAME}{UNIT}])(?: \\1)++", "$1")


def pieces(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def run_starts(template: Column) -> Column:
    """Places of the tokens of a template that ``collapsed`` keeps."""
    goes_on = lambda i: F.get(template, i).isin(NUMBER, NAME, UNIT) & (F.get(template, i) == F.get(template, i - 1))
    places = F.when(F.size(template) > 0, F.sequence(F.lit(0), F.size(template) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.coalesce(goes_on(i), F.lit(False)))


def run_values(starts: Column, tokens: Column) -> Column:
    """The lower-cased tokens at ``starts``, those of a run joined by blanks."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(tokens)))
    return F.zip_with(starts, ends, lambda a, b: F.lower(F.array_join(F.slice(tokens, a + 1, b - a), " ")))


def at_places(tokens: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(tokens, i))


def is_poor(window: Column, length: int | Column, params: TemplateParams) -> Column:
    """Whether a template window has too few plain words to be told from chance."""
    return F.size(F.filter(window, lambda t: ~t.isin(NUMBER, NAME, UNIT))) < F.least(F.lit(params.min_literal), F.lit(length))


# ---------------------------------------------------------------- hashes of windows


def _split(n: int) -> int:
    """A window of n > 1 tokens is hashed from one of this length, a power of two, and the rest."""
    return 1 << (n - 1).bit_length() - 1


def _token_hash(token: Column, exact: bool) -> Column:
    return F.xxhash64(F.lit("verbatim"), token) if exact else F.xxhash64(token)


def window_hash(tokens: Column, n: int, exact: bool, at: int = 0) -> Column:
    """Hash of the n tokens from ``at``."""
    if n == 1:
        return _token_hash(F.get(tokens, at), exact)
    p = _split(n)
    return F.xxhash64(window_hash(tokens, p, exact, at), window_hash(tokens, n - p, exact, at + p))


def with_window_hashes(frame: DataFrame, tokens: str, lengths: list[int], exact: bool) -> tuple[DataFrame, list[str]]:
    """``frame`` with a column of the hashes of all windows of each length, and these columns' names."""
    name = lambda n: f"{tokens}_{n}"
    wanted, todo = {1}, list(lengths)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += [_split(n), n - _split(n)]
    frame = frame.withColumn(name(1), F.transform(tokens, lambda t: _token_hash(t, exact)))
    for n in sorted(wanted - {1}):
        p, count = _split(n), F.size(tokens) - n + 1
        both = F.zip_with(F.slice(name(p), F.lit(1), count), F.slice(name(n - p), F.lit(p + 1), count), lambda a, b: F.xxhash64(a, b))
        frame = frame.withColumn(name(n), F.when(count > 0, both).otherwise(F.array().cast("array<bigint>")))
    return frame, [name(n) for n in lengths]


def benchmark_windows(benchmark: DataFrame, params: TemplateParams) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, raw, template, length, exact, n_windows) and their windows (h, length, exact,
    item, item_at). ``exact``: no template window has enough plain words, so all windows are hashed by their
    lower-cased tokens. A word that opens a sentence may be a name or not, and a copy may begin a sentence at
    any window: such windows have a hash for each reading. Items without a token (null, empty) have no
    windows; rows that repeat an item_id are items of their own."""
    tokens = F.col("tokens")
    items = (
        benchmark.select(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("\0")), "text").alias("item"), "item_id", "text")
        .withColumn("tokens", raw_tokens(F.col("text")))
        .where(F.size("tokens") > 0)
        .dropDuplicates(["item"])
        .withColumn("marked", F.regexp_extract_all("text", F.lit(MARKED), F.lit(0)))
        .withColumn("full", pieces(marked_classes(tokens)))
        .withColumn("starts", run_starts(F.col("full")))
        .select("item", "item_id", "tokens", "marked", "starts", F.transform(tokens, F.lower).alias("plain"), at_places(F.col("full"), F.col("starts")).alias("short"), run_values(F.col("starts"), tokens).alias("filled"))
    )
    opens = lambda i: (F.get("starts", i) == 0) | F.get("marked", F.get("starts", i)).rlike(r"^[.!?:\n]")
    literal = F.transform("short", lambda t, i: F.when((t == NAME) & opens(i) & ~F.contains(F.get("filled", i), F.lit(" ")), F.get("filled", i)).otherwise(t))
    items = items.withColumn("literal", literal).withColumn("length", F.least(F.size("short"), F.lit(params.window)))
    every = lambda tokens, length: F.explode(F.sequence(F.lit(0), F.size(tokens) - F.col(length)))
    cut = lambda tokens: F.slice(tokens, F.col("item_at") + 1, F.col("length"))
    rich = (
        items.withColumn("item_at", every("short", "length"))
        .select("item", "item_at", "length", cut("short").alias("w"), cut("literal").alias("v"))
        .where(~is_poor(F.col("v"), F.col("length"), params))
    )
    items = items.join(rich.groupBy("item").agg(F.count(F.lit(1)).alias("n_rich")), "item", "left").withColumn("exact", F.col("n_rich").isNull())
    items = items.withColumn("length", F.when(F.col("exact"), F.least(F.size("plain"), F.lit(params.window))).otherwise(F.col("length")))

    def of_length(tokens: Column, exact: bool) -> Column:
        out = F.lit(None).cast("bigint")
        for n in range(1, params.window + 1):
            out = F.when(F.col("length") == n, window_hash(tokens, n, exact)).otherwise(out)
        return out

    begun = F.when(~F.get("w", 0).isin(NUMBER, NAME, UNIT), F.concat(F.array(F.lit(NAME)), F.slice("w", F.lit(2), F.size("w"))))
    readings = rich.select("item", "item_at", "length", F.explode(F.array_compact(F.array_distinct(F.array(F.col("w"), F.col("v"), begun)))).alias("w"))
    poor = items.where("exact").withColumn("item_at", every("plain", "length")).select("item", "item_at", "length", cut("plain").alias("w"))
    windows = readings.select(of_length(F.col("w"), False).alias("h"), "length", F.lit(False).alias("exact"), "item", "item_at").unionByName(
        poor.select(of_length(F.col("w"), True).alias("h"), "length", F.lit(True).alias("exact"), "item", "item_at")
    )
    pick = lambda a, b: F.when(F.col("exact"), F.col(a)).otherwise(F.col(b))
    n_windows = F.when(F.col("exact"), F.size("plain") - F.col("length") + 1).otherwise(F.col("n_rich"))
    return items.select("item", "item_id", pick("plain", "filled").alias("raw"), pick("plain", "short").alias("template"), "length", "exact", n_windows.alias("n_windows")), windows


def document_windows(docs: DataFrame, kinds: list[tuple[int, bool]]) -> DataFrame:
    """(doc_id, content, place, h, n_short, n_plain) of the windows of ``docs`` (doc_id, content, text): for each
    (length, exact) in ``kinds``, one after the other, of the collapsed template or the lower-cased tokens."""
    # tokens and templates are columns of their own: inside a lambda they would be made again for every element
    base = docs.select("doc_id", "content", raw_tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    exact = [n for n, e in kinds if e]
    template = [n for n, e in kinds if not e]
    base = base.select("doc_id", "content", collapsed(marked_classes(F.col("raw"))).alias("joined"), (F.transform("raw", F.lower) if exact else F.array().cast("array<string>")).alias("plain"))
    base = base.select("doc_id", "content", F.split("joined", " ").alias("short"), "plain")
    base, by_template = with_window_hashes(base, "short", template, False)
    base, by_tokens = with_window_hashes(base, "plain", exact, True) if exact else (base, [])
    names = dict(zip([(n, False) for n in template] + [(n, True) for n in exact], by_template + by_tokens, strict=True))
    every = F.concat(F.array().cast("array<bigint>"), *(F.col(names[kind]) for kind in kinds))
    return base.select("doc_id", "content", F.size("short").alias("n_short"), F.size("plain").alias("n_plain"), F.posexplode(every).alias("place", "h"))


def place_in_kind(kinds: list[tuple[int, bool]]) -> Column:
    """``at`` of a matched window: its ``place`` without the windows of the kinds before its own."""
    out, before = F.lit(None).cast("int"), F.lit(0)
    for n, exact in kinds:
        out = F.when((F.col("length") == n) & (F.col("exact") == exact), F.col("place") - before).otherwise(out)
        before = before + F.greatest(F.col("n_plain" if exact else "n_short") - n + 1, F.lit(0))
    return out


def find_contaminated(docs: DataFrame, benchmark: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """Benchmark items that documents hold, verbatim or with other numbers, names or units.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. Windows of the
    canonical templates are hash-joined; a document holds an item when, on neighbouring alignments, it
    has at least ``min_cover`` of the item's windows and the slots are consistent: over the aligned
    placeholders, item values and document values map one to one. Items of any length are searched for;
    ones with too few plain words for a template are matched verbatim by their tokens, which a one-word
    item does wherever the word stands. Windows are exploded in the scan's
    stage and meet the benchmark's windows there by a broadcast whose row count is checked, so only
    matches are shuffled; a larger benchmark is joined by a shuffle.

    Returns one row for each (doc_id, item_id) with n_matched, cover and verbatim (all slots equal).
    Null or empty texts and empty tables give no rows; identical rows give identical results once. Long texts
    are taken whole, as one row. Of alignments that hold an item the one with most windows counts.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items, windows = benchmark_windows(benchmark, params)
    items, windows = scratch.keep(items, "items"), scratch.keep(windows, "windows")
    n_windows = windows.count()
    kinds = sorted((r.length, r.exact) for r in windows.select("length", "exact").distinct().collect())  # at most two for each length up to params.window
    small = F.broadcast(windows) if n_windows <= params.broadcast_rows else windows
    keyed = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    found = document_windows(keyed.where("text IS NOT NULL"), kinds)
    matched = (
        found.join(small, "h")
        .select("doc_id", "content", "item", "item_at", (place_in_kind(kinds) - F.col("item_at")).alias("shift"))
        .groupBy("doc_id", "content", "item", "shift")
        .agg(F.collect_set("item_at").alias("ats"))
    )
    # alignments at most ``drift`` apart meet in one of two groups at least
    group = lambda k: F.struct(F.lit(k), F.floor((F.col("shift") + k * params.drift) / (2 * params.drift)))
    matched = (
        matched.withColumn("group", F.explode(F.array(group(0), group(1))))
        .groupBy("doc_id", "content", "item", "group")
        .agg(F.sort_array(F.collect_list(F.struct((-F.size("ats")).alias("order"), "shift", "ats"))).alias("shifts"))
    )
    n_matched = lambda shifts: F.size(F.array_distinct(F.flatten(F.transform(shifts, lambda x: x["ats"]))))
    matched = matched.join(items.select("item", "n_windows"), "item").where(n_matched("shifts") >= params.min_cover * F.col("n_windows"))
    matched = scratch.keep(matched, "matched")
    hits = matched.groupBy("doc_id", "content").agg(F.collect_set(F.struct("item", "shifts", "n_windows")).alias("hits"))
    again = (
        keyed.join(hits.hint("merge"), [keyed.doc_id.eqNullSafe(hits.doc_id), keyed.content.eqNullSafe(hits.content)])
        .select(keyed.doc_id, raw_tokens(F.col("text")).alias("doc_raw"), "hits")
        .withColumn("doc_template", pieces(marked_classes(F.col("doc_raw"))))
        .withColumn("doc_starts", run_starts(F.col("doc_template")))
        .select("doc_id", "hits", at_places(F.col("doc_template"), F.col("doc_starts")).alias("doc_template"), run_values(F.col("doc_starts"), F.col("doc_raw")).alias("doc_filled"))
    )
    again = scratch.keep(again, "held").withColumn("hit", F.explode("hits")).select("doc_id", "doc_filled", "doc_template", "hit.*").join(items.drop("n_windows"), "item")
    # each alignment that has enough windows alone, and all of the group
    alone = F.transform(F.filter("shifts", lambda x: F.size(x["ats"]) >= params.min_cover * F.col("n_windows")), lambda x: F.array(x))
    again = again.withColumn("shifts", F.explode(F.array_distinct(F.concat(F.array("shifts"), alone)))).withColumn("n_matched", n_matched("shifts"))

    def slot(p: Column) -> Column:
        """Item and document at the item's token ``p``, aligned by the best alignment with a window over it."""
        over = F.get(F.filter("shifts", lambda x: F.exists(x["ats"], lambda a: (a <= p) & (p < a + F.col("length")))), 0)
        at = p + F.coalesce(over["shift"], F.get("shifts", 0)["shift"])
        value, found = F.get("raw", p), F.get("doc_filled", at)
        # at the item's ends, a run may go on in the document around it
        begins, ends = (p == 0) & F.endswith(found, F.concat(F.lit(" "), value)), (p == F.size("template") - 1) & F.startswith(found, F.concat(value, F.lit(" ")))
        return F.struct(
            F.get("template", p).alias("kind"), F.get("doc_template", at).alias("doc_kind"), value.alias("value"),
            F.when(begins | ends, value).otherwise(found).alias("doc_value"), over.isNotNull().alias("covered"),
        )

    again = again.withColumn("pairs", F.when(~F.col("exact"), F.transform(F.sequence(F.lit(0), F.size("template") - 1), slot)))
    # a word that is a name on one side only is that word on both
    strange = F.exists("pairs", lambda x: x["covered"] & (x["kind"] != x["doc_kind"]) & (x["value"] != x["doc_value"]))
    slots = F.filter("pairs", lambda x: x["kind"].isin(NUMBER, NAME, UNIT) & (x["kind"] == x["doc_kind"]))
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(*(x[n].alias(n) for n in names)))))
    pairs = distinct("kind", "value", "doc_value")
    whole = F.exists("shifts", lambda x: F.size(x["ats"]) == F.col("n_windows"))
    return (
        again.withColumn("slots", slots)
        .where(F.col("exact") | ~strange & (pairs == distinct("kind", "value")) & (pairs == distinct("kind", "doc_value")))
        .withColumn("verbatim", F.when(F.col("exact"), whole).otherwise(F.forall("slots", lambda x: x["value"] == x["doc_value"])))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_matched").alias("n_matched"), F.max(F.round(F.col("n_matched") / F.col("n_windows"), 6)).alias("cover"), F.max("verbatim").alias("verbatim"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged and with all columns."""
    bad = find_contaminated(docs, benchmark, params).select("doc_id").distinct().withColumnRenamed("doc_id", "bad_id")
    return docs.join(bad.hint("merge"), docs.doc_id.eqNullSafe(bad.bad_id), "left_anti")

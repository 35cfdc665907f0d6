"""PII surrogates in SQL functions only: keyed, type-consistent, distinct and coreferent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

# fixed values: surrogate given names by gender and script, and syllables of surrogate surnames
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Frida Greta Helga Irene Julia Karin Laura Marta Nadia Olivia Paula Rita Sofia Tessa Vera Wanda".split(),
    ("latin", "m"): "Albert Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Niels Oscar Peter Ralph Simon Thomas Victor".split(),
    ("latin", "n"): "Alex Ariel Casey Dana Eden Jamie Jules Kim Lee Morgan Noel Quinn Robin Sasha Taylor Toni Val Wren Yael Zion".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Мария Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Олег".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Тоша Вася Паша Шура Мика Ника".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιρις Κλειώ Λυδία Μαρία Νίκη Σοφία Χαρά".split(),
    ("greek", "m"): "Άρης Γιώργος Δήμος Ηλίας Κώστας Λέων Μάριος Νίκος Πέτρος Φώτης".split(),
    ("greek", "n"): "Άλκη Έρση Ήρα Κρις Λευκή Μάνια Νέλλη Ρένα Τζο Χάρη".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa we".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}
FEMALE = "Mrs Ms Miss Mme Madame Frau Señora Sra Signora Госпожа Κυρία".split()
MALE = "Mr Herr Señor Sr Monsieur Signor Господин Κύριος".split()
NEUTRAL = "Dr Prof Mx Доктор".split()

NAME = "struct<given:string,family:string,new_given:string,new_family:string>"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME_WORD = r"\p{Lu}[\p{L}'’-]+"
# in order: the first that matches at a place wins
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]*[\w%+-]@[\w-]+(?:\.[\w-]+)+",
    "secret": (
        r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)(?:gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{16,})(?!\w)"
        r"|-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----|(?<!\w)(?i:bearer) [0-9A-Za-z._~+/=-]{16,}"
        r"|(?i:password|passwd|secret|api[_-]?key|token)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',]{6,}[\"']?"
    ),
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<!\w)\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<!\w)0\d{2,4}[ /-]\d{5,8}(?!\w)",
    "ssn": r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "card": r"(?<!\w)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\w)",
    "name": rf"(?<!\w)(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? {NAME_WORD}(?: {NAME_WORD})?",
}
CARD = r"(?<!\w)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
ENTITY = "|".join(f"(?:{CARD if k == 'card' else p})" for k, p in PATTERNS.items())
# a cheap necessary condition of any pattern
HINT = r"[0-9@]|::|PRIVATE KEY|(?i:password|passwd|secret|api[_-]?key|token|bearer )|(?<!\w)(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? "


@dataclass(frozen=True)
class SurrogateParams:
    """key: secret of the replacement, which the caller has to give; the same key gives the same surrogates for
    the same entities. rounds: at most this many redraws of entities whose surrogates collide."""

    key: str
    rounds: int = 60

    def __post_init__(self):
        if not self.key:
            raise ValueError("surrogates need a secret key")


def entity_type(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{CARD if kind == 'card' else pattern})$"), kind).otherwise(out)
    return out


def canonical(value: Column, kind: Column) -> Column:
    """What mentions of one entity share: digits of numbers, lower case of emails, else the value."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind.isin("email", "ipv6"), F.lower(value))
        .otherwise(value)
    )


def name_parts(value: Column) -> tuple[Column, Column, Column]:
    """Title, given name (null for one word) and family name of a titled name."""
    words = F.split(value, " ")
    return F.get(words, 0), F.when(F.size(words) > 2, F.get(words, 1)), F.element_at(words, -1)


def name_kinds(value: Column) -> tuple[Column, Column]:
    """Kinds of a titled name's given and family name: all names of a kind have surrogates of one script, and
    given names of one gender."""
    title, _, _ = name_parts(value)
    bare = F.regexp_replace(title, r"\.", "")
    script = F.when(value.rlike(r" .*\p{IsCyrillic}"), "cyrillic").when(value.rlike(r" .*\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(bare.isin(FEMALE), "f").when(bare.isin(MALE), "m").otherwise("n")
    return F.concat_ws(":", F.lit("given"), script, gender), F.concat_ws(":", F.lit("family"), script)


def _hash(key: str, *parts: Column) -> Column:
    """Keyed hash (hash of key and message, hashed with the key again), 128 hex digits."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)
    return F.sha2(F.concat(F.lit(key + "\x1f"), inner), 512)


def _pick(words: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.conv(F.substring(h, at, 6), 16, 10).cast("bigint") % len(words) + 1).cast("int"))


def _masked(value: Column, h: Column) -> Column:
    """Character by character: a digit for a digit (not zero for a first digit that isn't), a letter of
    the same case and script for a letter; hex strings stay hex; other characters stay."""
    hexish = value.rlike(r"^[0-9a-f\":]*$")
    chars = F.split(value, "")
    plain = F.filter(chars, lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substr(h, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int") + i / 64
        n = n.cast("int")
        letter = lambda base, size: F.char(F.lit(ord(base)) + n % size)
        wide = lambda alphabet: F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))
        return (
            F.when(c.rlike("[1-9]") & (i == 0), (n % 9 + 1).cast("string"))
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(hexish & c.rlike("[a-f]"), letter("a", 6))
            .when(c.rlike("[a-z]"), letter("a", 26))
            .when(c.rlike("[A-Z]"), letter("A", 26))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.lower(c), wide("абвгдежзиклмнопрстуфхцчшэюя")).otherwise(F.upper(wide("абвгдежзиклмнопрстуфхцчшэюя"))))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c == F.lower(c), wide("αβγδεζηθικλμνξοπρστυφχψω")).otherwise(F.upper(wide("αβγδεζηθικλμνξοπρστυφχψω"))))
            .when(c.rlike(r"\p{L}"), F.when(c == F.lower(c), letter("a", 26)).otherwise(letter("A", 26)))
            .otherwise(c)
        )

    return F.array_join(F.transform(plain, one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    back = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    return F.aggregate(
        F.transform(back, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _card(digits: Column, h: Column) -> Column:
    """The issuer's first digit and the length stay; the check digit is valid if it was."""
    masked = _masked(F.expr("substring(canon, 2, length(canon) - 2)"), h)
    body = F.concat(F.substring(digits, 1, 1), masked)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    other = F.conv(F.substring(h, 120, 2), 16, 10).cast("int") % 9
    wrong = F.when(other >= check, other + 1).otherwise(other)
    return F.concat(body, F.when(_luhn_sum(digits) % 10 == 0, check).otherwise(wrong).cast("string"))


def _family(script: str, h: Column, attempt: Column) -> Column:
    """Four syllables; more of them after each four draws that collided."""
    more = [F.when(attempt >= 4 * (i + 1), _pick(SYLLABLES[script], h, 60 + 8 * i)).otherwise("") for i in range(6)]
    return F.initcap(F.concat(*(_pick(SYLLABLES[script], h, at) for at in (20, 30, 40, 50)), *more))


def _given(script: str, gender: str, h: Column, attempt: Column) -> Column:
    """A name of the gender; two names after draws that collided, then a third made of syllables."""
    names = GIVEN[script, gender]
    third = F.concat_ws("-", _pick(names, h, 1), _family(script, h, attempt - 8))
    return F.when(attempt < 2, _pick(names, h, 1)).when(attempt < 8, F.concat_ws("-", _pick(names, h, 1), _pick(names, h, 9))).otherwise(third)


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """``surrogate`` of each (kind, canon, attempt), in canonical form."""
    kind, canon = F.col("kind"), F.col("canon")
    h = F.col("h")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    tail = F.substring_index(domain, ".", -1)
    head = F.expr("substring(substring_index(canon, '@', -1), 1, length(substring_index(canon, '@', -1)) - length(substring_index(canon, '.', -1)) - 1)")
    octet = lambda at: (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    secret_lead = (
        r"^(?:AKIA|ASIA|gh[pousr]_|sk-|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:bearer) |(?i:password|passwd|secret|api[_-]?key|token)[\"']?\s*[=:]\s*[\"']?)"
    )
    lead = F.regexp_extract(canon, secret_lead, 0)
    trail = F.regexp_extract(canon, r"(?:[\"']|-----END [A-Z ]*PRIVATE KEY-----)$", 0)
    secret = F.expr("substring(canon, length(lead) + 1, length(canon) - length(lead) - length(trail))")
    attempt = F.col("attempt")
    # a format with few forms widens: one more character after each eight draws that collided, another range
    extra = F.substr(h, F.lit(100), F.floor(attempt / 8).cast("int"))
    small = canon.rlike(r"^192\.168\.") & (attempt < 8)
    first = F.when(small, "192").when(canon.rlike(r"^(?:10|192\.168)\."), "10").when(canon.rlike(r"^127\."), "127").otherwise(octet(1))
    unique_local = F.concat(F.lit("fd"), *(F.concat(F.substring(h, 1 + 4 * i, 2 if i == 0 else 4), F.lit(":" if i < 7 else "")) for i in range(8)))
    names = F.lit(None).cast("string")
    for script in SYLLABLES:
        names = F.when(kind == f"family:{script}", _family(script, h, attempt)).otherwise(names)
    for script, gender in GIVEN:
        names = F.when(kind == f"given:{script}:{gender}", _given(script, gender, h, attempt)).otherwise(names)
    return (
        entities.withColumn("h", _hash(key, kind, canon, attempt.cast("string")))
        .withColumn("hd", _hash(key, F.lit("domain"), head))  # the same domain for all its addresses
        .withColumn("lead", lead)
        .withColumn("trail", trail)
        .withColumn(
            "surrogate",
            F.when(kind == "email", F.concat(_masked(local, h), extra, F.lit("@"), _masked(head, F.col("hd")), F.lit("."), tail))
            .when(kind == "ip", F.concat_ws(".", first, F.when(small, "168").otherwise(octet(5)), octet(9), octet(13)))
            .when(kind == "ipv6", F.when(attempt < 4, _masked(canon, h)).otherwise(unique_local))
            .when(kind == "card", _card(canon, h))
            # a country code, before the last ten digits, stays
            .when((kind == "phone") & (F.length(canon) > 10), F.concat(F.expr("substring(canon, 1, length(canon) - 10)"), _masked(F.expr("right(canon, 10)"), h)))
            .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _masked(F.expr("substring(canon, 3)"), h)))
            .when(kind == "secret", F.concat(F.col("lead"), extra, _masked(secret, h), F.col("trail")))
            .when(kind.startswith("family") | kind.startswith("given"), names)
            .otherwise(_masked(canon, h)),
        )
        .drop("h", "hd", "lead", "trail")
    )


def assign_surrogates(entities: DataFrame, params: SurrogateParams, scratch: Scratch) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon) rows.

    Drawn by keyed hash; a surrogate that is itself an entity of the corpus, or that an entity with a
    smaller canonical form of the same kind has drawn too, is drawn again with the next attempt
    number. A format with few forms widens as attempts go on: private addresses to another private range,
    names by syllables, secrets and mailboxes by characters. Ends when none collides; entities of a format that
    can't widen (numbers) and still collide after ``rounds`` draws raise an error rather than share a surrogate.
    """
    canons = scratch.keep(entities.select("kind", "canon").distinct(), "canons")
    drawn = _draw(canons.withColumn("attempt", F.lit(0)), params.key)
    for _ in range(params.rounds):
        drawn = scratch.keep(drawn, "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = canons.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        bad = (
            first.join(taken, ["kind", "surrogate"], "left")
            .where((F.col("n") > 1) | F.col("real"))
            .select("kind", "surrogate", "real", F.when(F.col("real").isNull(), F.col("first.canon")).alias("winner"))
        )
        bad = scratch.keep(bad, "bad")
        if bad.isEmpty():
            return drawn.select("kind", "canon", "surrogate")
        marked = drawn.join(bad, ["kind", "surrogate"], "left")
        redo = (F.col("real") | (F.col("winner").isNotNull() & (F.col("winner") != F.col("canon"))))
        marked = marked.withColumn("redo", F.coalesce(redo, F.lit(False)))
        drawn = marked.where(~F.col("redo")).select("kind", "canon", "attempt", "surrogate").unionByName(
            _draw(marked.where("redo").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), params.key)
        )
    raise ValueError(f"surrogates still collide after {params.rounds} draws")


def _render(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: separators of numbers, case of emails, dot of a title."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    kept = F.when(kind == "iban", r"[^A-Z0-9]").otherwise(r"\D")

    def one(c: Column, i: Column) -> Column:
        n = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), kept, F.lit("")))
        return F.when(F.regexp_replace(c, kept, F.lit("")) == "", c).otherwise(F.substr(surrogate, n, F.lit(1)))

    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.array_join(F.transform(chars, one), ""))
        .when(kind.isin("email", "ipv6") & (value == F.upper(value)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def _cased(word: Column, surrogate: Column) -> Column:
    """In capitals where the mention is."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(surrogate)).otherwise(surrogate)


def _again(text: Column, names: Column) -> Column:
    """``text`` between mentions, with untitled mentions of the document's names replaced: whole names, then
    family names."""
    alone = lambda name: F.concat(F.lit(r"(?<![\p{L}'’-])"), name, F.lit(r"(?![\p{L}'’-])"))
    whole = F.aggregate(
        F.filter(names, lambda x: x["given"].isNotNull()), text,
        lambda acc, x: F.regexp_replace(acc, alone(F.concat_ws(" ", x["given"], x["family"])), F.concat_ws(" ", x["new_given"], x["new_family"])),
    )
    return F.aggregate(names, whole, lambda acc, x: F.regexp_replace(acc, alone(x["family"]), x["new_family"]))


def replace_private(docs: DataFrame, params: SurrogateParams) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, all columns and rows kept, plus ``n_entities``.

    ``docs`` needs doc_id and text; other columns pass through under their own names. Mentions of one
    entity (same digits, same address in any case, same given or family name) get one surrogate in the whole
    corpus, different entities different ones; kind, gender, script, case and separators stay. Names are
    found after a title; their other mentions in the same text, whole or as family names, are replaced
    too, and not counted. A null text stays null, an empty one empty; long texts are taken whole. Rows that
    repeat an id with the same text change alike. Of patterns that match at one place the first in
    ``PATTERNS`` counts. An empty table gives no rows.

    Texts that cannot hold an entity pass in the scan; only (row key, place, mention) rows of the others
    are joined with the surrogates, so an entity that a third of the rows mention moves small rows,
    which AQE can split.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    columns = docs.columns
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    mentions = F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0))
    found = (
        docs.where(hinted)
        .select("doc_id", F.xxhash64("text").alias("content"), mentions.alias("mentions"))
        .where(F.size("mentions") > 0)
        .dropDuplicates(["doc_id", "content"])
    )
    found = scratch.keep(found.select("doc_id", "content", F.posexplode("mentions").alias("at", "value")), "mentions")
    values = found.select("value").distinct().withColumn("kind", entity_type(F.col("value"))).where("kind IS NOT NULL")
    values = scratch.keep(values.withColumn("canon", canonical(F.col("value"), F.col("kind"))), "values")
    _, given, family = name_parts(F.col("value"))
    given_kind, family_kind = name_kinds(F.col("value"))
    names = values.where("kind = 'name'").select("value", given.alias("given"), family.alias("family"), given_kind.alias("given_kind"), family_kind.alias("family_kind"))
    entities = (
        values.where("kind <> 'name'").select("kind", "canon")
        .unionByName(names.where("given IS NOT NULL").select(F.col("given_kind").alias("kind"), F.lower("given").alias("canon")))
        .unionByName(names.select(F.col("family_kind").alias("kind"), F.lower("family").alias("canon")))
    )
    surrogates = scratch.keep(assign_surrogates(entities, params, scratch), "surrogates")
    part = lambda name: surrogates.select(F.col("kind").alias(f"{name}_kind"), F.col("canon").alias(f"{name}_canon"), F.col("surrogate").alias(f"new_{name}"))
    names = (
        names.withColumn("given_canon", F.lower("given")).withColumn("family_canon", F.lower("family"))
        .join(part("given"), ["given_kind", "given_canon"], "left").join(part("family"), ["family_kind", "family_canon"])
        .withColumn("new_given", _cased(F.col("given"), F.col("new_given"))).withColumn("new_family", _cased(F.col("family"), F.col("new_family")))
    )
    title = F.substring_index("value", " ", 1)
    name = F.struct("given", "family", "new_given", "new_family")
    rendered = (
        values.join(surrogates, ["kind", "canon"]).select("value", _render(F.col("value"), F.col("kind"), F.col("surrogate")).alias("new"), F.lit(None).cast(NAME).alias("name"))
        .unionByName(names.select("value", F.concat_ws(" ", title, "new_given", "new_family").alias("new"), name.cast(NAME).alias("name")))
    )
    per_doc = (
        found.join(rendered.hint("merge"), "value", "left")
        .groupBy(F.col("doc_id").alias("key_id"), F.col("content").alias("key_content"))
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "value").alias("new")))), lambda x: x["new"]).alias("new"),
            F.array_sort(F.collect_set("name")).alias("names"),
        )
    )
    touched = docs.where(hinted).withColumn("__content", F.xxhash64("text")).join(
        per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("key_id")) & F.col("__content").eqNullSafe(F.col("key_content")), "left"
    )
    between = F.split("text", ENTITY, -1)
    rebuilt = F.array_join(F.transform(between, lambda part, i: F.concat(F.when(F.size("names") > 0, _again(part, F.col("names"))).otherwise(part), F.coalesce(F.get("new", i), F.lit("")))), "")
    out = F.when(F.col("new").isNull(), F.col("text")).otherwise(rebuilt)
    n = F.coalesce(F.size("new"), F.lit(0))
    n = F.when(F.col("new").isNull(), 0).otherwise(n)
    changed = touched.withColumn("__text", out).select(*(F.col("__text").alias(c) if c == "text" else F.col(c) for c in columns), n.cast("int").alias("n_entities"))
    return docs.where(~hinted).select(*columns, F.lit(0).cast("int").alias("n_entities")).unionByName(changed)

"""Personal data: surrogate generation.

Entities (e-mail addresses, telephone numbers, payment cards, IBANs, IP
addresses, secrets, national ids, and names after a form of address) are replaced
by keyed surrogates of the same type and format.  All expressions are built-in
SQL functions: a text is cut at its entities, each entity becomes its surrogate,
and the parts are joined again, so documents are not shuffled.

A surrogate is drawn character by character from a keyed stream, sha2(key, kind,
normal form), in the format of the entity at hand: digits become digits, letters
letters of the same case and script, separators stay.  The stream is indexed by
the place among the letters and digits, so "+1 (017) 555-7713" and "1 017 555
7713" get the same digits (coreference).  Card numbers keep a valid or invalid
check digit, IP octets stay octets, e-mail domains become reserved ones, and
given names come from lists by gender and script.  A family name is an entity of
its own, so "Frau Anna Berg", "Herr Berg" and "Dr Berg" share one whatever is
drawn again; the given names belong to the whole name.

Collision check: over all documents, the distinct surface forms of the entities
are gathered with their surrogates.  An entity any form of which becomes itself,
an entity of the corpus, or a surrogate of another entity (of those the smallest
keeps it) draws again with the next attempt, until no collision is left; the
attempts of such entities are joined to the rows that hold them.  From attempt
WIDE on, formats of few values widen step by step (octets of any length, one more
letter or digit, a second given name), so that two-letter names or one-digit
octets cannot run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import stored

#: Attempts in an entity's own format before it widens.
WIDE = 6
#: Rounds that settle no entity at all before the search is given up.
STALLED = 30

# Forms of address by gender, given names by gender and script.
TITLES_M = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа")
TITLES_N = ("Dr", "Prof", "Mx")
GIVEN = {
    ("m", "latin"): "Adam Albert Anton Arthur Bruno Carl Daniel David Edgar Emil Erik Felix Frank Georg Hugo Ivan Jakob Jonas "
                    "Karl Leon Louis Lukas Marco Martin Max Nils Oscar Otto Paul Peter Rafael Robert Simon Stefan Thomas Victor".split(),
    ("f", "latin"): "Ada Alma Amelie Anna Clara Diana Elena Ella Emma Eva Flora Greta Hanna Helena Ida Irene Jana Julia Karin "
                    "Laura Lea Lena Linda Lucia Maria Marta Mila Nina Nora Olga Paula Rita Rosa Sara Sofia Vera".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Игорь Кирилл Максим Николай Олег Павел Роман Сергей Юрий".split(),
    ("f", "cyrillic"): "Алина Анна Вера Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Светлана Татьяна Юлия".split(),
}

_NAME = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
_TITLE = "|".join((*TITLES_M, *TITLES_F, *TITLES_N))
#: (kind, pattern), the first that matches at a place wins.
KINDS: tuple[tuple[str, str], ...] = (
    ("email", r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|sk-|xox[abprs]-)[A-Za-z0-9-]{20,255}"
               r"|(?=[0-9]{0,39}[a-fA-F])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9])"
              r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?(?![0-9])|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5}(?![0-9])"),
    ("person", rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}"),
)


def _pattern() -> str:
    parts, groups = [], 0
    for kind, p in KINDS:
        if kind == "card":
            p = p.replace(r"\1", rf"\{groups + 1}").replace(r"\2", rf"\{groups + 2}")
        parts.append(p)
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(parts)})"


PATTERN = _pattern()


def kind_of(entity: Column) -> Column:
    out = None
    for kind, p in KINDS:
        test = entity.rlike(f"^(?:{p})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.otherwise(F.lit("secret"))


def normal(entity: Column, kind: Column) -> Column:
    """What identifies an entity: e-mail in lower case, names without the form of
    address, else letters and digits."""
    name = _name_of(entity)
    return (F.when(kind == "email", F.lower(entity)).when(kind == "person", name).when(kind.isin("ip", "secret", "family"), entity)
            .otherwise(F.upper(F.regexp_replace(entity, "[^0-9A-Za-z]", ""))))


def _draw(seed: Column, i: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(seed, i), n.cast("bigint")).cast("int")


def _letters(text: Column, seed: Column) -> Column:
    """Every letter and digit replaced by one of its class; the rest stays."""
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        # place among letters and digits, so that separators don't shift the stream
        at = F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        return (
            F.when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), _draw(seed, at, 10) + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(seed, at, 26) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _draw(seed, at, 26) + 1, F.lit(1)))
            .when(c.rlike("[а-я]"), F.substring(F.lit("абвгдежзийклмнопрстуфхцчшщъыьэюя"), _draw(seed, at, 32) + 1, F.lit(1)))
            .when(c.rlike("[А-Я]"), F.substring(F.lit("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"), _draw(seed, at, 32) + 1, F.lit(1)))
            .when(c.rlike(r"\p{Ll}"), F.substring(F.lit("àáâäçèéêëíîïñóôöùúûü"), _draw(seed, at, 20) + 1, F.lit(1)))
            .when(c.rlike(r"\p{Lu}"), F.substring(F.lit("ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"), _draw(seed, at, 20) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def _hex(text: Column, seed: Column) -> Column:
    """Hexadecimal digits replaced by such, in the case of the text; the first is a letter if it was one."""
    lower = ~text.rlike("[A-F]")
    digits = F.when(lower, F.lit("0123456789abcdef")).otherwise(F.lit("0123456789ABCDEF"))

    def one(c: Column, i: Column) -> Column:
        from_, n = F.when(c.rlike("[0-9]"), F.lit(1)).otherwise(F.lit(11)), F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(6))
        return F.substring(digits, from_ + _draw(seed, i, n), F.lit(1))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits (its last one included), modulo 10."""
    def add(acc: Column, x: Column) -> Column:
        d = x["d"].cast("int") * F.when(x["i"] % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add) % 10


def _card(text: Column, seed: Column) -> Column:
    """A number of the same format whose check digit is as valid as the original's."""
    fresh = _letters(text, seed)
    zero = F.concat(fresh.substr(F.lit(1), F.length(fresh) - 1), F.lit("0"))
    check = (10 - _luhn(F.regexp_replace(zero, "[^0-9]", ""))) % 10
    valid = _luhn(F.regexp_replace(text, "[^0-9]", "")) == 0
    last = F.when(valid, check).otherwise((check + 1 + _draw(seed, F.lit(99), 9)) % 10)
    return F.concat(fresh.substr(F.lit(1), F.length(fresh) - 1), last.cast("string"))


def _widened(text: Column, attempt: Column, filler: Column) -> Column:
    """The text with one more filler for each attempt from WIDE on."""
    return F.concat(text, F.repeat(filler, F.greatest(attempt - (WIDE - 1), F.lit(0))))


def _ip(text: Column, seed: Column, attempt: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        n = F.length(o)
        return (F.when(attempt >= WIDE, _draw(seed, i, 256)).when(n == 3, 100 + _draw(seed, i, 156))
                .when(n == 2, 10 + _draw(seed, i, 90)).otherwise(_draw(seed, i, 10))).cast("string")

    return F.array_join(F.transform(F.split(text, r"\."), octet), ".")


def _email(text: Column, seed: Column, attempt: Column) -> Column:
    """Local part in its format, a sub-domain of the same format below a reserved domain."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    head = F.regexp_replace(F.regexp_replace(domain, r"\.[^.]+$", ""), r"\.?example$", "")
    head = F.when(F.length(head) < 6, F.rpad(head, 6, "a")).otherwise(head)
    fresh = F.concat(_letters(_widened(local, attempt, F.lit("0")), seed), F.lit("@"), _letters(head, F.concat(seed, F.lit("d"))), F.lit(".example."))
    last = F.element_at(F.array(F.lit("com"), F.lit("org"), F.lit("net")), _draw(seed, F.lit(-1), 3) + 1)
    return F.concat(fresh, F.when(text.rlike("[a-z]"), last).otherwise(F.upper(last)))


def _name_of(text: Column) -> Column:
    return F.regexp_replace(text, rf"^(?:{_TITLE})\.? ", "")


def _family(part: Column, key: Column, attempt: Column) -> Column:
    filler = F.when(part.rlike(r"\p{IsCyrillic}"), F.lit("а")).otherwise(F.lit("a"))
    return _letters(_widened(part, attempt, filler), F.sha2(F.concat_ws("|", key, F.lit("family"), part, attempt.cast("string")), 256))


def _given(text: Column, key: Column, attempt: Column) -> Column:
    """Array of the given names of a form of address with a name (all parts but the last)."""
    name = _name_of(text)
    title = F.regexp_extract(text, rf"^((?:{_TITLE})\.? )", 1)
    female = title.rlike(rf"^(?:{'|'.join(TITLES_F)})(?!\p{{L}})")
    male = title.rlike(rf"^(?:{'|'.join(TITLES_M)})(?!\p{{L}})")

    def pick(part: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", key, F.lit("given"), part, name, attempt.cast("string")), 256)
        cyrillic = part.rlike(r"\p{IsCyrillic}")
        known_f = part.isin(*GIVEN["f", "latin"], *GIVEN["f", "cyrillic"])
        of_f = F.coalesce(female & ~male, F.lit(False)) | (~male & known_f)

        def one(gender: str, script: str) -> Column:
            names = GIVEN[gender, script]
            return F.element_at(F.array(*map(F.lit, names)), _draw(seed, F.lit(gender), len(names)) + 1)

        first = (F.when(of_f & cyrillic, one("f", "cyrillic")).when(of_f, one("f", "latin"))
                 .when(cyrillic, one("m", "cyrillic")).otherwise(one("m", "latin")))
        second = _widened(F.when(cyrillic, F.lit("Ааа")).otherwise(F.lit("Aaa")), attempt, F.when(cyrillic, F.lit("а")).otherwise(F.lit("a")))
        return F.when(attempt < WIDE, first).otherwise(F.concat(first, F.lit("-"), _letters(second, seed)))

    parts = F.split(name, " ")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), pick)


def surrogate(entity: Column, kind: Column, attempt: Column, key: str, family_attempt: Column | None = None) -> Column:
    """The keyed surrogate of an entity; a name's last part is drawn with the family name's attempt."""
    k = F.lit(key)
    seed = F.sha2(F.concat_ws("|", k, kind, normal(entity, kind), attempt.cast("string")), 256)
    # a telephone number keeps its country code
    code = F.regexp_extract(entity, r"^(\+[0-9]{1,3}(?=[ .(-]))", 1)
    number = _widened(entity.substr(F.length(code) + 1, F.length(entity)), attempt, F.lit("0"))
    last = _family(F.substring_index(entity, " ", -1), k, F.lit(0) if family_attempt is None else family_attempt)
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    return (
        F.when(kind == "email", _email(entity, seed, attempt))
        .when(kind == "ip", _ip(entity, seed, attempt))
        .when(kind == "card", _card(entity, seed))
        .when(kind == "phone", F.concat(code, _letters(number, seed)))
        .when(kind == "person", F.concat(title, F.array_join(F.concat(_given(entity, k, attempt), F.array(last)), " ")))
        .when(kind == "family", _family(entity, k, attempt))
        .when((kind == "secret") & entity.rlike("^[0-9a-fA-F]+$"), _hex(entity, seed))
        .when(kind == "secret", F.concat(F.regexp_extract(entity, "^(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)", 1),
                                         _letters(F.regexp_replace(entity, "^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)", ""), seed)))
        .when(kind == "iban", F.concat(entity.substr(1, 2), _letters(entity.substr(F.lit(3), F.length(entity)), seed)))
        .otherwise(_letters(entity, seed))
    )


def _entities(text: Column) -> Column:
    """Array of (entity, kind, norm) of a text, in order."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)),
        lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind"), normal(e, kind_of(e)).alias("norm")))


def _drawn(entity: Column, kind: Column, attempt: Column, key: str) -> Column:
    """What must differ between entities: the normal form of the surrogate; of a whole name its new given
    names with the old family name, as family names are told apart on their own."""
    whole = F.array_join(F.concat(_given(entity, F.lit(key), attempt), F.array(F.substring_index(entity, " ", -1))), " ")
    return F.when(kind == "person", whole).otherwise(normal(surrogate(entity, kind, attempt, key), kind))


def redraws(forms: DataFrame, key: str) -> DataFrame | None:
    """Attempts above 0 of the entities (kind, norm) that need them, from their surface
    forms (kind, norm, entity); None if there is none.

    Deterministic in the set of forms: of entities that drew the same surrogate
    the smallest keeps it.  There is no limit on the attempts; only when a fixed
    format (cards, national ids) is used up, so that STALLED rounds on end
    settle nothing, an error is raised."""
    taken = forms.select("kind", F.col("norm").alias("drawn")).distinct().withColumn("real", F.lit(True))
    state = forms.withColumn("attempt", F.lit(0))
    least, stalled, redrawn = None, 0, False
    while True:
        drawn = stored(state.withColumn("drawn", _drawn(F.col("entity"), F.col("kind"), F.col("attempt"), key)), "drawn")
        owners = drawn.groupBy("kind", "drawn").agg(F.min("norm").alias("owner"), F.max("norm").alias("other"))
        clash = owners.join(taken, ["kind", "drawn"], "left").where("owner <> other or real")
        bad = drawn.join(clash, ["kind", "drawn"]).where(F.coalesce("real", F.lit(False)) | (F.col("owner") != F.col("norm")))
        bad = stored(bad.select("kind", "norm").distinct(), "collisions")
        n = bad.count()
        if not n:
            changed = drawn.where("attempt > 0").select("kind", "norm", "attempt").distinct()
            return changed if redrawn else None
        redrawn = True
        stalled = 0 if least is None or n < least else stalled + 1
        least = n if least is None else min(n, least)
        if stalled >= STALLED:
            raise RuntimeError(f"{n} entities find no surrogate of their format")
        again = bad.withColumn("more", F.lit(1))
        state = drawn.drop("drawn").join(again, ["kind", "norm"], "left").withColumn(
            "attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")


def _keys(found: Column) -> Column:
    """What is drawn for a text's entities, each once: (kind, norm, entity), names as family name and, with given names, as a whole."""
    last = F.transform(F.filter(found, lambda e: e["kind"] == "person"), lambda e: F.struct(
        F.substring_index(e["norm"], " ", -1).alias("entity"), F.lit("family").alias("kind"),
        F.substring_index(e["norm"], " ", -1).alias("norm")))
    own = F.filter(found, lambda e: (e["kind"] != "person") | e["norm"].contains(" "))
    return F.array_distinct(F.concat(own, last))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities, kinds (of the entities, in order), surrogates (in order).

    ``key`` is the secret that the surrogates depend on: who has it can compute
    them again, so it must come from the settings of the job.  Null texts stay
    null (no entities), empty texts and texts without entities come back
    unchanged; long texts are searched whole; repeated rows get equal results;
    null ids are kept. An empty table gives an empty result; other columns are
    not read."""
    if not key:
        raise ValueError("a key is required")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.select(F.explode(_keys(_entities(F.col("text")))).alias("e"))
    forms = stored(found.select("e.kind", "e.norm", "e.entity").distinct(), "entities")
    again = redraws(forms, key)
    held = rows.withColumn("found", F.coalesce(_entities(F.col("text")), F.array().cast("array<struct<entity:string,kind:string,norm:string>>")))
    if again is None:
        held = held.withColumn("attempts", F.array().cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        # only the entities of rows move, and only those that draw again come back
        held = held.withColumn("row", F.xxhash64("doc_id", "text"))
        needs = held.select("row", F.explode(_keys(F.col("found"))).alias("e"))
        needs = needs.select("row", "e.kind", "e.norm").join(again, ["kind", "norm"]).distinct()
        held = held.join(needs.groupBy("row").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("attempts")), "row", "left")
        held = held.withColumn("attempts", F.coalesce("attempts", F.array().cast("array<struct<kind:string,norm:string,attempt:int>>")))

    def attempt_of(kind: Column, norm: Column) -> Column:
        own = F.filter("attempts", lambda a: (a["kind"] == kind) & (a["norm"] == norm))
        return F.when(F.size("attempts") == 0, 0).otherwise(F.coalesce(F.get(own, F.lit(0))["attempt"], F.lit(0)))

    def replaced(e: Column) -> Column:
        family = attempt_of(F.lit("family"), F.substring_index(e["norm"], " ", -1))
        return surrogate(e["entity"], e["kind"], attempt_of(e["kind"], e["norm"]), key, family)

    done = held.withColumn("surrogates", F.transform("found", replaced))
    parts = F.split(F.col("text"), PATTERN)
    joined = F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size("surrogates")), F.col("surrogates"), lambda a, b: F.concat(a, b)), ""),
                      F.element_at(parts, -1))
    return done.select(
        "doc_id", F.when(F.size("surrogates") == 0, F.col("text")).otherwise(joined).alias("text"),
        F.size("surrogates").cast("bigint").alias("n_entities"), F.transform("found", lambda e: e["kind"]).alias("kinds"), "surrogates")

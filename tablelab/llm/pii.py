"""PII: detected entities get keyed surrogates, in DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, payment cards (issuer and
check digit are tested), IPv4 addresses, social security numbers, secrets
(labelled ones and access keys) and names after a title. Mailboxes and secrets
hold a letter or digit: ``password: ________`` and ``...@x.com`` are left. A match is cut into
units: an address into mailbox and domain, a name into given name and surname.
In a text with such a name every capitalised word is looked at, too: those that
are a given name or surname found in it are replaced as these are.
Every unit has a normal form, and a surrogate for it that depends on a key, its
kind, the normal form and a number of attempts:

- letters and digits are moved within their alphabet (case and script stay, hex
  stays hex), so that length and format stay; scripts without an alphabet here
  are moved within 32 neighbouring code points of their kind;
- cards keep their issuer and get a valid check digit, octets stay octets;
- Latin and Cyrillic names are composed of syllables, some millions of them, with
  endings of their gender. A given name's gender is what its titles in the corpus
  say; a name with titles of both or none has endings that go with both.

One normal form has one surrogate in the whole corpus, whatever the title or spelling in
a text (coreference). The collision check keeps units apart: a surrogate that
another unit of the kind has, or that is itself a unit found in the corpus, is
tried again, until none is left (mailboxes are compared with their domain, phone
numbers with their country code, which is 1 in formats without one and none in national
numbers that begin with 0); after ``GROW`` attempts in the unit's own format
each further one makes the surrogate a character or syllable longer (an IPv4 address an
octet), so that a format without free texts ends no run. Each unit's text is then written in the format
of its place (separators, capitals). Units that stand in many places (``HOT``) get
their surrogates by a broadcast, at most one in ``HOT`` places.

Defined cases: null texts stay null; texts without entities are returned as they
are; repeated rows get the same text; an address has at most 127 labels behind
its mailbox; other columns are kept, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tablelab.session import materialise

#: Titles by gender.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora"), "x": ("Dr", "Prof")}
#: Syllables that names are composed of, by script: beginnings, middles, vowels between two of them, and endings.
SYLLABLES = {
    "latin": (
        "al an ar be bi bri ca ce co da de do ed el em er fa fe ga ge gi ha he in is ja jo ju ka ke la le li lo lu ma me mi mo na ne ni no o pa pe ra re ri ro ru sa se si so ta te ti to va ve vi wa we yo za",
        "b br d dr f g l ld ll lm ln m mb n nd nn nt r rd rl rm rn rr s sk ss st t tt v vr z", "a e i o u",
    ),
    "cyrillic": (
        "ал ан бо ва ве га да де до ел жа за зо ка ки ко ла ле ли ма ми мо на не ни па ра ри ро са се со та ти то фе",
        "б в г д ж з к л м н р с т ль нд рт ст", "а е и о у",
    ),
}
ENDINGS = {
    "given:latin": {"m": "o us an en ias ert ard in ik or", "f": "a ia ina ella etta ene isa ora ika ya", "x": "y is ey i el e ou in"},
    "given:cyrillic": {"m": "ий ан ей ор ил ислав", "f": "а ия ина ена ора", "x": "я и е"},
    "surname:latin": {"x": "er mann son ley ton ez i ard sen ers ova ski well field"},
    "surname:cyrillic": {"x": "ов ев ин ский ко ук"},
}
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
GROW, ATTEMPTS, HOT = 8, 64, 100_000

_LABEL = r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?"
_TITLE = r"\b(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\.? "
_NAME = r"\p{Lu}(?=[\p{L}'-])\p{L}*+(?:['-]\p{L}{2,}+){0,4}"
#: A word that may be a name; a hyphen joins capitalised parts only, and no label of a secret.
_WORD = r"(?<![\p{L}\p{N}])\p{Lu}(?=[\p{L}'-])\p{L}*+(?:['-]\p{Lu}\p{L}++(?![_=:])){0,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+-])(?=[._%+-]*+[\p{L}\p{N}])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]+){0,126}\.\p{L}{2,}",
        _LABEL + r"(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{8,}",
        r"\bAKIA[A-Z0-9]{16}\b",
        r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\p{N})",
        r"(?<![\p{L}\p{N}.,/+-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\p{N}-])",
        r"(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\p{N})",
        r"(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{N}-])",
        r"(?<![\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\p{N}|\.\p{N})",
        r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
        r"(?<![\p{L}\p{N}-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
        _TITLE + _NAME + "(?: " + _NAME + ")?",
    ]
)
#: The pattern for texts with names.
WIDE = PATTERN + "|" + _WORD


def _may_hold(text: Column) -> Column:
    """What every match needs, as far as it is cheap to see: a digit or sign, an access key's head or a title."""
    heads = ["AKIA", *(t for ts in TITLES.values() for t in ts)]
    return functools.reduce(lambda a, b: a | b, [text.contains(h) for h in heads], text.rlike("[0-9@=:]"))


def _has_match(text: Column) -> Column:
    return F.coalesce(_may_hold(text) & text.rlike(PATTERN), F.lit(False))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The sum that a valid card number has as a multiple of ten."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x) % 10


def _kind(match: Column) -> Column:
    digits = _digits(match)
    issuer = digits.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)")
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike("^" + _LABEL), "secret")
        .when(match.startswith("AKIA"), "secret")
        .when(match.rlike("^" + _TITLE), "name")
        .when(match.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^[+(]|^\d{3}[.-]|^0\d{2,4}[ /-]"), "phone")
        .when(issuer & (_luhn(digits) == 0), "card")
        .when(match.rlike(r"^\p{Lu}[\p{L}'-]*$"), "word")
    )


def _unit(before: Column, kind: Column, norm: Column, shown: Column, gender: Column | None = None) -> Column:
    of = F.lit(None).cast("string") if gender is None else gender
    return F.struct(before.alias("before"), kind.alias("kind"), norm.alias("norm"), shown.alias("shown"), of.alias("gender"))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _units(match: Column) -> Column:
    """The units of a match: what stands before each, kind, normal form, the text as it is shown and the gender that a title says. A kind of null is left as it is."""
    kind, nothing = _kind(match), F.lit("")
    mailbox, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    label = F.regexp_extract(match, "^" + _LABEL, 0)
    secret = F.substr(match, F.length(label) + 1, F.length(match))
    title = F.regexp_extract(match, "^" + _TITLE, 0)
    name = F.split(F.substr(match, F.length(title) + 1, F.length(match)), " ")
    bare = F.regexp_replace(title, r"[. ]", "")
    gender = F.when(bare.isin(*TITLES["m"]), "m").when(bare.isin(*TITLES["f"]), "f")
    last = F.element_at(name, -1)
    surname = F.concat(F.lit("surname:"), _script(last))
    given = _unit(title, F.concat(F.lit("given:"), _script(name[0])), F.lower(name[0]), name[0], gender)
    country = F.regexp_extract(match, r"^\+\d{1,3}[ .-]", 0)
    number = F.substr(match, F.length(country) + 1, F.length(match))
    code = F.when(country != "", _digits(country)).when(match.rlike(r"^\+|^0\d{2,4}[ /-]"), "").otherwise("1")  # the other formats without a code are American
    phone = F.ltrim(F.concat(code, F.lit(" "), _digits(number)))
    return (
        F.when(kind == "email", F.array(_unit(nothing, F.lit("mailbox"), F.lower(match), mailbox), _unit(F.lit("@"), F.lit("domain"), F.lower(domain), domain)))
        .when(kind == "secret", F.array(_unit(label, F.lit("secret"), secret, secret)))
        .when((kind == "name") & (F.size(name) > 1), F.array(given, _unit(F.lit(" "), surname, F.lower(last), last)))
        .when(kind == "name", F.array(_unit(title, surname, F.lower(last), last)))
        .when(kind == "phone", F.array(_unit(country, F.lit("phone"), phone, number)))
        .when(kind == "word", F.array(_unit(nothing, kind, F.lower(match), match)))
        .when(kind.isin("card", "ssn"), F.array(_unit(nothing, kind, _digits(match), match)))
        .otherwise(F.array(_unit(nothing, kind, match, match)))
    )


def _moved_elsewhere(c: Column, by: Column) -> Column:
    """A letter or digit that no alphabet lists: the next one of its kind among 32 neighbouring code points, from the ``by``-th on."""
    code = F.ascii(c).cast("long")
    low = code - code % 32

    def at(i: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(low + (code + by + i) % 32), 8, "0")), "UTF-32")

    def alike(x: Column) -> Column:
        same = [x.rlike(p) == c.rlike(p) for p in (r"^\p{Lu}$", r"^\p{N}$", r"^\p{Ll}$")]
        return functools.reduce(lambda a, b: a & b, same, x.rlike(r"^[\p{L}\p{N}]$"))

    near = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), at), alike), 0)
    return F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.coalesce(near, c)).otherwise(c)


_LETTERS = " ".join(ALPHABETS)


def _moved(text: Column, noise: Column, hexadecimal: Column) -> Column:
    """Each letter and digit moved within its alphabet by what the noise holds at its place."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(noise, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 31)
        at = F.instr(F.lit(_LETTERS), c)
        head = F.substring_index(F.substr(F.lit(_LETTERS), F.lit(1), at - 1), " ", -1)
        alphabet = F.concat(head, F.substring_index(F.substr(F.lit(_LETTERS), at), " ", 1))
        size = F.when(hexadecimal & c.rlike("^[a-fA-F]$"), 6).otherwise(F.length(alphabet))
        listed = F.substr(alphabet, ((F.length(head) + by) % size).cast("int") + 1, F.lit(1))
        return F.when((c == " ") | (c == ""), c).when(at > 0, listed).when(c > "\x7f", _moved_elsewhere(c, by)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _composed(of: str, noise: Column, gender: Column, attempt: Column) -> Column:
    """A name of syllables that the noise chooses; from the second attempt on with one more, from ``GROW`` on one more an attempt."""
    begin, middle, vowels = SYLLABLES[of.split(":")[1]]

    def pick(texts: str, place: Column | int) -> Column:
        choice = texts.split()
        number = F.conv(F.substr(noise, F.lit(1) + F.lit(place) * 5 if isinstance(place, int) else F.lit(1) + place * 5, F.lit(6)), 16, 10).cast("long")
        return F.get(F.array(*map(F.lit, choice)), (number % len(choice)).cast("int"))

    longer = F.when((attempt > 0) | (F.substr(noise, F.lit(64), F.lit(1)) > "7"), 1).otherwise(0)
    more = longer + F.greatest(attempt - GROW + 1, F.lit(0))
    inner = F.transform(F.sequence(F.lit(1), F.lit(1) + more), lambda i: F.when(i > 1, F.concat(pick(vowels, (i * 2) % 11), pick(middle, (i * 2 + 1) % 11))).otherwise(pick(middle, 1)))
    ending = functools.reduce(lambda out, g: F.when(gender == g, pick(ENDINGS[of][g], 11)).otherwise(out), [g for g in ENDINGS[of] if g != "x"], pick(ENDINGS[of]["x"], 11))
    return F.concat(pick(begin, 0), F.array_join(inner, ""), ending)


def _grown(kind: Column, norm: Column, attempt: Column) -> Column:
    """The normal form whose letters and digits are moved: longer by a character an attempt from ``GROW`` on."""
    by = F.greatest(attempt - GROW + 1, F.lit(0))
    letter = F.when(kind.endswith(":cyrillic"), "а").when(kind.endswith(":greek"), "α").otherwise("a")
    label = F.substring_index(norm, ".", 1)
    return (
        F.when(kind == "domain", F.concat(label, F.repeat(F.lit("0"), by), F.substr(norm, F.length(label) + 1)))
        .when(kind == "mailbox", F.concat(F.substring_index(norm, "@", 1), F.repeat(F.lit("0"), by)))
        .when(kind == "ip", F.concat(norm, F.repeat(F.lit(".0"), by)))
        .when(kind.rlike("^(given|surname)"), F.concat(norm, F.repeat(letter, by)))
        .otherwise(F.concat(F.substring_index(norm, " ", -1), F.repeat(F.lit("0"), by)))
    )


def surrogate(key: str, kind: Column, norm: Column, gender: Column, attempt: Column) -> Column:
    """The keyed surrogate of a normal form: also a normal form."""
    made = F.struct(
        F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256).alias("noise"),
        _grown(kind, norm, attempt).alias("grown"),
        (norm.rlike("^([0-9a-f]+|[0-9A-F]+)$") & (kind == "secret")).alias("hex"),
    )
    # Bound once: what stands in a lambda is computed for every character.
    return F.get(F.transform(F.array(made), lambda x: _formed(kind, norm, gender, attempt, x["noise"], x["grown"], x["hex"])), 0)


def _formed(kind: Column, norm: Column, gender: Column, attempt: Column, noise: Column, grown: Column, hexadecimal: Column) -> Column:
    number = F.conv(F.substr(noise, F.lit(50), F.lit(8)), 16, 10).cast("long")
    first = F.substr(grown, F.lit(1), F.lit(1)).cast("int")

    def octet(o: Column, i: Column) -> Column:
        by = F.conv(F.substr(noise, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(i == 0, F.pmod(o.cast("int") - 1 + by, F.lit(223)) + 1).otherwise((o.cast("int") + by) % 256).cast("string")

    def formed(moved: Column) -> Column:
        nonzero = F.concat(F.when(first > 0, (first - 1 + number) % 9 + 1).otherwise(0).cast("string"), F.substr(moved, F.lit(2), F.length(moved)))
        body = F.concat(F.substr(grown, F.lit(1), F.lit(4)), F.substr(moved, F.lit(5), F.length(moved) - 5))
        card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
        address = F.array_join(F.transform(F.split(grown, r"\."), octet), ".")
        labels = F.split(grown, r"\.")
        domain = F.array_join(F.concat(F.slice(F.split(moved, r"\."), F.lit(1), F.size(labels) - 1), F.slice(labels, -1, 1)), ".")
        key_id = F.concat(F.lit("AKIA"), F.substr(moved, F.lit(5), F.length(moved)))
        return (
            F.when(kind.isin("phone", "ssn"), nonzero)
            .when(kind == "card", card)
            .when(kind == "ip", address)
            .when(kind == "domain", domain)
            .when((kind == "secret") & norm.startswith("AKIA"), key_id)
            .otherwise(moved)
        )

    out = F.transform(F.array(_moved(grown, noise, hexadecimal)), formed)[0]
    for of in ENDINGS:
        out = F.when(kind == of, _composed(of, noise, gender, attempt)).otherwise(out)
    return out


def _whole(kind: Column, norm: Column, surrogate: Column) -> Column:
    """What collisions are checked on: a mailbox with its domain, a number with its country code.

    Domains have surrogates of their own, so addresses that differ here differ in the corpus that is written.
    """
    return (
        F.when(kind == "mailbox", F.concat(surrogate, F.lit("@"), F.substring_index(norm, "@", -1)))
        .when((kind == "phone") & norm.contains(" "), F.concat(F.substring_index(norm, " ", 1), surrogate))
        .otherwise(surrogate)
    )


def assign_surrogates(units: DataFrame, key: str) -> DataFrame:
    """``kind``, ``norm``, ``surrogate`` and ``places`` of the distinct ``kind`` and ``norm``: no two alike within a kind, none a unit of the corpus.

    Mailboxes (``norm`` is the address) are told apart within their domain, phone numbers (code, space, number) within their country.
    """
    gender = F.col("gender") if "gender" in units.columns else F.lit(None).cast("string")
    said = units.groupBy("kind", "norm").agg(F.count("*").alias("places"), F.min(gender).alias("least"), F.max(gender).alias("most"))
    both = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("x")
    units = materialise(said.select("kind", "norm", "places", both.alias("gender")), "units")
    known = units.select("kind", F.when(F.col("kind") == "phone", F.replace("norm", F.lit(" "), F.lit(""))).otherwise(F.col("norm")).alias("whole")).distinct()
    done, waiting = [], units
    made = surrogate(key, F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"))
    for attempt in range(ATTEMPTS):
        tried = waiting.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", made)
        tried = tried.withColumn("whole", _whole(F.col("kind"), F.col("norm"), F.col("surrogate")))
        free = tried.join(functools.reduce(DataFrame.unionAll, [known, *[d.select("kind", "whole") for d in done]]), ["kind", "whole"], "left_anti")
        won = free.groupBy("kind", "whole").agg(F.min(F.struct("norm", "surrogate", "places")).alias("w"))
        done.append(materialise(won.select("kind", "w.norm", "w.surrogate", "w.places", "whole"), "surrogates"))
        waiting = materialise(waiting.join(done[-1], ["kind", "norm"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return functools.reduce(DataFrame.unionAll, done).drop("whole")
    raise ValueError("some units have no surrogate of their own")


def _shown(kind: Column, found: Column, shown: Column) -> Column:
    """A surrogate in the format of the place: digits between the same separators and what has grown behind them, capitals as there."""

    def place(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(shown, F.lit(1), i + 1)))
        return F.when(c.rlike(r"^\d$"), F.substr(found, before, F.lit(1))).otherwise(c)

    more = F.substr(found, F.length(_digits(shown)) + 1)
    filled = F.concat(F.array_join(F.transform(F.split(shown, ""), place), ""), more)
    capital = F.when((shown == F.upper(shown)) & (shown != F.lower(shown)), F.upper(found))
    return (
        F.when(kind.isin("phone", "ssn", "card"), filled)
        .when(kind.rlike("^(given|surname)"), F.coalesce(capital, F.initcap(found)))
        .when(kind.isin("mailbox", "domain"), F.coalesce(capital, found))
        .otherwise(found)
    )


def _with_surrogates(places: DataFrame, made: DataFrame) -> DataFrame:
    """``places`` with the surrogates of their units; those of units in many places do not go through the shuffle."""
    made = made.select("kind", "norm", "surrogate", "places")
    hot, rest = made.filter(F.col("places") >= HOT).drop("places"), made.filter(F.col("places") < HOT).drop("places")
    if hot.isEmpty():
        return places.join(rest, ["kind", "norm"], "left")
    usual = places.join(F.broadcast(hot), ["kind", "norm"], "left_anti").join(rest, ["kind", "norm"], "left")
    return usual.unionByName(places.join(F.broadcast(hot), ["kind", "norm"]))


def replace_pii(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with entities replaced in ``text``; ``count`` names a column for their number."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    key_of = F.struct(F.xxhash64("text").alias("h"), F.md5("text").alias("m"))  # the new text depends on the text alone
    matches = rows.filter(_has_match(F.col("text"))).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    matches = matches.withColumn("named", F.exists("found", lambda m: m.rlike("^" + _TITLE)))
    found = F.when(F.col("named"), F.regexp_extract_all("text", F.lit(WIDE), F.lit(0))).otherwise(F.col("found"))
    matches = matches.select("row", "text", "named", key_of.alias("key"), found.alias("found"))
    touched = materialise(matches.withColumn("units", F.transform("found", _units)).drop("found"), "pii")

    places = touched.select("key", F.posexplode("units").alias("i", "units")).select("key", "i", F.posexplode("units").alias("j", "u"))
    places = places.select("key", "i", "j", "u.*")
    own = places.filter(F.col("kind").isNull() | (F.col("kind") != "word"))
    names = own.filter(F.col("kind").rlike("^(given|surname):")).groupBy("key", "norm").agg(F.min("kind").alias("kind"))
    again = places.filter("kind = 'word'").drop("kind").join(names, ["key", "norm"], "left")
    places = materialise(own.unionByName(again.select(*own.columns)), "places")
    pieces = _with_surrogates(places, assign_surrogates(places.filter("kind IS NOT NULL"), key))
    new = F.concat("before", F.coalesce(_shown(F.col("kind"), F.col("surrogate"), F.col("shown")), F.col("shown")))
    cell = F.struct("i", "j", new.alias("new"), F.col("kind").isNotNull().alias("is"))
    # A set: the cells of copies of a text are dropped before the shuffle and in it.
    found = pieces.groupBy("key").agg(F.array_sort(F.collect_set(cell)).alias("new"))

    gaps = F.when(F.col("named"), F.split("text", WIDE, -1)).otherwise(F.split("text", PATTERN, -1))
    filled = F.transform("new", lambda x: F.concat(F.when(x["j"] == 0, F.get("gaps", x["i"])).otherwise(""), x["new"]))
    changed = touched.join(found, "key").withColumn("gaps", gaps).select(
        "row",
        F.concat(F.array_join(filled, ""), F.element_at("gaps", -1)).alias("text"),
        F.size(F.filter("new", lambda x: x["is"] & (x["j"] == 0))).alias("n"),
    )
    clean = rows.filter(~_has_match(F.col("text"))).withColumn("n", F.lit(0))
    kept = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != count]
    return changed.unionByName(clean).select(*kept, *([] if count is None else [F.col("n").alias(count)]))

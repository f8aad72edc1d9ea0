"""Pseudonymisation: detected entities get keyed, type-consistent surrogates.

Everything on the main path is a DataFrame or SQL function.  One regular expression
finds the entities; a text is split at it and put together again with surrogates, so a
document needs no join and no shuffle.

*Surrogates* depend on a key, the type and the value only: equal values get equal
surrogates in the whole corpus (coreference), and so do mail addresses and secrets that
differ in case, and phones that differ in the punctuation behind a separate country code.  Card, phone, social-security and
IP numbers are mapped by a keyed Feistel permutation of their digits (or 16-bit halves),
which keeps the format and is one-to-one; a card keeps its distance from a valid check
digit.  Mail addresses keep their shape (a local part with digits if it had some) under
reserved example domains; equal domains stay equal.  Secrets (hex digits of either case)
keep length and case, provider keys their prefix and the kind of every character,
bank account numbers (IBAN) their country and a valid check number.  Names keep their
title, take a first name of the gender that the title implies, and are written in the
script of the original (Latin or Cyrillic); a surname is always replaced alike.

*Collision checks.*  A surrogate is made of parts (the local part and the domain of an
address, the first and the last name, or the whole value), each with a canonical form.
The distinct parts of the corpus are pre-aggregated once; a part whose surrogate equals
another's surrogate or somebody's real value is given the next attempt, until there is
none, and later attempts draw from larger spaces.  Other parts keep theirs: a new first
name changes no surname.  Only texts that hold such a part look it up; normally there
are none and the look-up is not part of the plan.

*Scans.*  A text is searched twice, for the collision check and for the replacement:
keeping what the first search found would write the corpus once more.

Defined results for odd input: a null text stays null; empty texts stay empty; very
long texts are processed whole; repeated rows give repeated rows; rows without a doc_id,
or without that column, are treated like others; an empty table gives an empty result;
further columns pass through unchanged whatever their names, but for ``n_entities``,
which the result's own column replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: The setting that holds the key of the registered query; anyone who knows the key can invert the permutations.
KEY_SETTING, TEST_KEY = "spark.sparkfolio.surrogates.key", "for test tables only"
ROUNDS = 6

#: Titles by gender.
MALE_TITLES = ("Mr", "Herr", "Herrn", "Señor", "Monsieur", "Господин", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Госпожа", "госпожа")
#: First names by script and gender, and syllables of surnames by script.
FIRST_NAMES = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karel", "Leon", "Martin", "Nico", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Фёдор"),
    ("cyrillic", "f"): ("Алина", "Божена", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fi", "ga", "go", "ha", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "so", "ta", "te", "to"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "та", "то"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
#: Entities that begin with a digit, as they may follow a phone.
_NEXT = rf"(?:{_IP}|(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-])|(?<![\w-])\d{{4}}(?:[ -]\d{{4}}){{3}}(?![\w-]|[ -]\d{{4}})|\d{{13,19}}(?!\d)|[0-9a-fA-F]{{32}}|[\p{{L}}\p{{N}}._%+-]{{1,64}}@)"
#: How keys of well-known providers begin.
_PROVIDER = r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|[spr]k[-_](?:live[-_]|test[-_]|proj[-_])?)"
_IPV6 = r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
_TITLE = "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))
PATTERNS = (
    r"[\p{L}\p{N}._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    rf"(?<![0-9A-Za-z_-]){_PROVIDER}(?=[A-Za-z_-]*[0-9])[0-9A-Za-z]{{16,}}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:(?: [0-9A-Z]{4}){3,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![0-9A-Za-z])",
    rf"(?<![0-9A-Za-z:]){_IPV6}(?![0-9A-Za-z:])",
    r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])",
    rf"(?<![\d.]){_IP}",
    # A phone ends before an entity that follows it; only without such an end may its groups look like one.
    rf"(?<![\d+])\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:(?:\.?|[ -](?!{_NEXT}))\d{{2,4}}){{2,4}}(?!\d)",
    r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w-])\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\w-])",
    r"(?<!\d)\d{13,19}(?!\d)",
    rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
)
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS).replace(r"([ -])\d{4}\1\d{4}\1", r"(?:[ -]\d{4}){2}[ -]")
#: What any entity contains: a text without it is not searched further.
_QUICK = rf"@|\+\d|\d{{3}}|\d\.\d|[0-9a-fA-F]{{32}}|[0-9a-fA-F]:[0-9a-fA-F]|[A-Z]{{2}}\d\d|{_PROVIDER}|(?:{_TITLE})"


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _number(text: Column) -> Column:
    """A keyed 56-bit number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, salt: Column) -> Column:
    """A keyed permutation of pairs (l < left_size, r < right_size); rounds change the halves in turn."""

    def one(state, i):
        word = lambda half: _number(F.concat_ws("|", salt, i.cast("string"), half.cast("string")))
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(state["l"] + F.pmod(word(state["r"]), left_size), left_size)).otherwise(state["l"]).alias("l"),
            F.when(odd, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(word(state["l"]), right_size), right_size)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), one)


def _permuted_digits(digits: Column, salt: Column) -> Column:
    """A keyed permutation of digit strings of one length (2 to 36)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    mixed = _feistel(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, n).cast("long"), size(a), size(n - a), salt)
    return _let(mixed, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))


def _fill(mask: Column, digits: Column) -> Column:
    """The digits of ``mask`` replaced one by one."""
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))

    def step(state, c):
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substring(state["rest"], 1, 1)).otherwise(c)).alias("out"),
            F.when(is_digit, F.substring(state["rest"], F.lit(2), F.length(state["rest"]))).otherwise(state["rest"]).alias("rest"),
        )

    return F.aggregate(F.filter(F.split(mask, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def _digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _check_digit(body: Column) -> Column:
    """The digit that makes ``body`` and it pass the Luhn check."""
    n = F.length(body)

    def add(total, i):
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.pmod(F.lit(10) - F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)), F.lit(10))


def _card(value: Column, salt: Column) -> Column:
    def with_digits(d):
        body, last = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1)).cast("int")
        return _let(
            _permuted_digits(body, salt),
            lambda new: F.concat(new, F.pmod(_check_digit(new) + last - _check_digit(body), F.lit(10)).cast("string")),
        )

    return _fill(value, _let(_digits_of(value), with_digits))


def _phone(value: Column, salt: Column) -> Column:
    prefix = F.when(value.startswith("("), "(").otherwise(F.coalesce(F.nullif(F.regexp_extract(value, r"^\+\d{1,3}(?=[ (.-])", 0), F.lit("")), F.substring(value, 1, 2)))

    def with_prefix(p):
        rest = F.substring(value, F.length(p) + 1, F.length(value))
        return F.concat(p, _fill(rest, _permuted_digits(_digits_of(rest), F.concat_ws("|", salt, p))))

    return _let(prefix, with_prefix)


def _address(value: Column, salt: Column) -> Column:
    def with_octets(o):
        octet = lambda i: F.get(o, F.lit(i)).cast("long")
        mixed = _feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), salt)
        return _let(mixed, lambda s: F.concat_ws(".", *[(F.floor(s[h] / 256) if k == 0 else s[h] % 256).cast("string") for h in ("l", "r") for k in (0, 1)]))

    return _let(F.split(value, r"\."), with_octets)


def _letters(text: Column, n: int) -> Column:
    """n letters from a keyed hash."""
    return F.substring(F.translate(F.sha2(text, 256), "0123456789", "ghijklmnop"), 1, n)


def _email(value: Column, local_salt: Column, domain_salt: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    tail = F.when(local.rlike(r"\d"), F.concat(F.lit("."), F.lpad((_number(F.concat(local_salt, F.lit("#"), F.lower(value))) % 100).cast("string"), 2, "0"))).otherwise("")
    return F.concat(
        _letters(F.concat_ws("|", local_salt, F.lower(value)), 14), tail,
        F.lit("@"), _letters(F.concat_ws("|", domain_salt, F.lower(domain)), 10), F.lit(".example.org"),
    )


def _secret(value: Column, salt: Column) -> Column:
    """Hex digits of the same number and case; secrets that differ in case only get the same digits."""
    word, n = F.concat_ws("|", salt, F.lower(value)), F.length(value)
    # 128 digits a part; parts after the second start from the first, so that a long secret is hashed twice only.
    def parts(first):
        rest = F.when(n > 256, F.transform(F.sequence(F.lit(2), F.floor((n + 127) / 128).cast("int")), lambda i: F.sha2(F.concat(first, F.lit("+"), i.cast("string")), 512)))
        return F.concat(first, F.sha2(F.concat(word, F.lit("+")), 512), F.coalesce(F.array_join(rest, ""), F.lit("")))

    def cased(made):
        each = F.zip_with(F.split(value, ""), F.split(made, ""), lambda old, new: F.when(old.rlike("[A-F]"), F.upper(new)).otherwise(new))
        return F.when(~value.rlike("[A-F]"), made).when(~value.rlike("[a-f]"), F.upper(made)).otherwise(F.array_join(each, ""))

    return _let(F.substring(_let(F.sha2(word, 512), parts), F.lit(1), n), cased)


def _stream(value: Column, word: Column) -> Column:
    """A keyed byte, as two hex digits, for every character of ``value``."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", word, b.cast("string")), 512)), "")


def _like(value: Column, salt: Column, hexadecimal: bool = False) -> Column:
    """Every letter and digit replaced by one of its kind."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def with_bytes(stream):
        def one(c, i):
            byte = F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
            if hexadecimal:
                return F.when(c.rlike("[0-9a-fA-F]"), F.lower(F.hex(byte % 16))).otherwise(c)
            letter = lambda a: F.char(F.lit(ord(a)) + byte % 26)
            return F.when(c.between("0", "9"), (byte % 10).cast("string")).when(c.between("a", "z"), letter("a")).when(c.between("A", "Z"), letter("A")).otherwise(c)

        return F.array_join(F.transform(chars, one), "")

    return _let(_stream(value, F.concat_ws("|", salt, value)), with_bytes)


def _provider_key(value: Column, salt: Column) -> Column:
    prefix = F.regexp_extract(value, rf"^{_PROVIDER}", 0)
    return F.concat(prefix, _like(F.substring(value, F.length(prefix) + 1, F.length(value)), salt))


def _account(value: Column, salt: Column) -> Column:
    """An IBAN: the country stays, characters keep their kind, and the check number is valid."""
    country, mask = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))

    def with_body(body):
        solid = F.filter(F.split(F.concat(F.translate(body, " ", ""), country, F.lit("00")), ""), lambda c: c != "")
        digit = lambda c: c.between("0", "9")
        rest = F.aggregate(solid, F.lit(0), lambda r, c: F.when(digit(c), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)

    # The words are those without spaces: an account is the same in groups and without.
    bare = _like(F.translate(mask, " ", ""), salt)
    grouped = lambda b: F.when(mask.contains(" "), F.concat(F.lit(" "), F.trim(F.regexp_replace(b, r"(.{4})", "$1 ")))).otherwise(b)
    return _let(_let(bare, grouped), with_body)


def _last(value: Column) -> Column:
    return F.lower(F.substring_index(value, " ", -1))


def _words_of(value: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", "")


def _is_female(value: Column) -> Column:
    return F.rtrim(F.regexp_extract(value, rf"^(?:{_TITLE})\.?", 0), F.lit(".")).isin(*FEMALE_TITLES)


def _name(value: Column, given_salt: Column, given_attempt: Column, family_salt: Column, family_attempt: Column) -> Column:
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.?", 0)
    words = _words_of(value)
    script = F.when(words.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    part = lambda number, bits, i: F.pmod(F.call_function("shiftrightunsigned", number, (bits * i).cast("int")), F.lit(1 << bits)).cast("int")

    def build(which):
        syllables = F.array(*map(F.lit, SYLLABLES[which]))
        pool = lambda g: F.array(*map(F.lit, FIRST_NAMES[(which, g)]))
        # "Mr Gray" and "Mr John Gray" get one surname; an attempt adds a syllable, or one more first name.
        family = lambda n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.least(family_attempt, F.lit(6)) + 4), lambda i: F.get(syllables, part(n, 5, i))), ""))
        first = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), F.least(given_attempt, F.lit(12))), lambda i: F.get(F.when(_is_female(value), pool("f")).otherwise(pool("m")), part(n, 4, i))), "-")
        last = _let(_number(F.concat_ws("|", family_salt, _last(words))), family)
        return F.when(words.contains(" "), F.concat(_let(_number(F.concat_ws("|", given_salt, F.lower(words))), first), F.lit(" "), last)).otherwise(last)

    return F.concat(title, F.lit(" "), F.when(script == "cyrillic", build("cyrillic")).otherwise(build("latin")))


def entity_type(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^(?:{_TITLE})\.? "), "name")
        .when(value.startswith("+") | value.startswith("("), "phone")
        .when(value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[0-9a-fA-F]{32,}$"), "secret")
        .when(value.contains(":"), "ipv6")
        .when(value.rlike(rf"^{_PROVIDER}"), "provider")
        .when(value.rlike(r"^[A-Z]{2}"), "account")
        .otherwise("card")
    )


def parts_of(value: Column) -> Column:
    """(part, id) of an entity: what is replaced on its own, in a form that spellings of one thing share."""
    kind = entity_type(value)
    part = lambda name, i: F.struct(F.lit(name).alias("part"), i.alias("id"))
    whole = F.when(kind == "phone", F.concat(F.substring(value, 1, 1), _digits_of(value))).when(kind == "card", _digits_of(value)).when(
        kind.isin("secret", "ipv6"), F.lower(value)
    ).when(kind == "account", F.translate(value, " ", "")).otherwise(value)
    words = _words_of(value)
    given = part("given", F.concat(F.when(_is_female(value), "f ").otherwise("m "), F.lower(words)))
    return (
        F.when(kind == "email", F.array(part("local", F.lower(value)), part("domain", F.lower(F.substring_index(value, "@", -1)))))
        .when(kind == "name", F.when(words.contains(" "), F.array(given, part("family", _last(words)))).otherwise(F.array(part("family", _last(words)))))
        .otherwise(F.array(F.struct(kind.alias("part"), whole.alias("id"))))
    )


def surrogate(value: Column, key: str, attempt=None) -> Column:
    """The surrogate of one entity; ``attempt(part, id)`` gives the attempts of parts that collided, else all are the first."""
    kind = entity_type(value)

    def build(found):
        def salted(name, i=F.lit(0)):
            n = F.lit(0) if attempt is None else attempt(F.lit(name), F.get(found, i)["id"])
            return F.concat_ws("|", F.lit(key), F.lit(name), n.cast("string")), n

        def of(name, make):
            return make(value, salted(name)[0])

        given, family = salted("given"), salted("family", F.size(found) - 1 if attempt else None)
        return (
            F.when(kind == "email", _email(value, salted("local")[0], salted("domain", F.lit(1))[0]))
            .when(kind == "name", _name(value, *given, *family))
            .when(kind == "phone", of("phone", _phone))
            .when(kind == "ip", of("ip", _address))
            .when(kind == "ssn", of("ssn", lambda v, s: _fill(v, _permuted_digits(_digits_of(v), s))))
            .when(kind == "secret", of("secret", _secret))
            .when(kind == "ipv6", of("ipv6", lambda v, s: _like(F.lower(v), s, True)))
            .when(kind == "provider", of("provider", _provider_key))
            .when(kind == "account", of("account", _account))
            .otherwise(of("card", _card))
        )

    return _let(parts_of(value), build) if attempt else build(None)


def found_in(text: Column) -> Column:
    """The entities of a text, in order; null if there are none."""
    return F.when(F.regexp_like(text, F.lit(_QUICK)), F.nullif(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>")))


def _found_rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.explode(found_in(F.col(text_col))).alias("value"))


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(part, id, attempt) of the parts whose first surrogate collides; almost always empty.

    Parts and surrogates are compared within one kind of part, in their canonical forms.
    Of several parts with one surrogate the least keeps it.
    """
    values = _found_rows(docs, text_col).distinct().select("value", F.explode(parts_of(F.col("value"))).alias("p"))
    # One spelling stands for a part.
    ids = stash(values.groupBy("p.part", "p.id").agg(F.min("value").alias("value")), "entities")
    current = ids.withColumn("attempt", F.lit(0))
    while True:
        own = lambda part, _: F.when(F.col("part") == part, F.col("attempt")).otherwise(F.lit(0))
        made = _let(surrogate(F.col("value"), key, own), lambda m: F.filter(parts_of(m), lambda p: p["part"] == F.col("part"))[0]["id"])
        named = stash(current.withColumn("made", made), "surrogates")
        shared = named.groupBy(F.col("part").alias("_p"), F.col("made").alias("_m")).agg(F.min("id").alias("_keeps"), F.count("*").alias("_n")).where("_n > 1")
        real = ids.select(F.col("part").alias("_p"), F.col("id").alias("_m"))
        same = (F.col("part") == F.col("_p")) & (F.col("made") == F.col("_m"))
        bad = (
            named.join(shared.hint("merge"), same).where("id <> _keeps").select("part", "id")
            .unionByName(named.join(real.hint("merge"), same, "left_semi").select("part", "id"))
            .distinct()
        )
        bad = stash(bad.select(F.col("part").alias("_p"), F.col("id").alias("_i")), "collisions")
        if bad.isEmpty():
            return named.where("attempt > 0").select("part", "id", "attempt")
        again = (F.col("part") == F.col("_p")) & (F.col("id") == F.col("_i"))
        current = named.join(bad.hint("merge"), again, "left").select(
            "part", "id", "value", (F.col("attempt") + F.col("_i").isNotNull().cast("int")).alias("attempt")
        )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with entities replaced, and ``n_entities``."""
    if not key:
        raise ValueError("a key is needed: without one anybody can compute the surrogates")
    again = stash(collisions(docs, key, text_col), "attempts")
    columns = [c for c in docs.columns if c != "n_entities"]
    # Rows travel as one struct beside their text, so that no column of theirs can clash with ours.
    rows = docs.select(F.struct(*[c for c in columns if c != text_col], F.lit(0).alias("_end")).alias("_row"), F.col(text_col).alias("_text"))
    marked = rows.withColumn("_found", found_in(F.col("_text")))
    attempt = None
    if not again.isEmpty():
        # Only texts with such a part get a map of attempts; equal texts share it.
        digest = F.sha2(F.col("_text"), 256)
        affected = (
            rows.select(digest.alias("_d"), F.explode(F.array_distinct(found_in(F.col("_text")))).alias("_v"))
            .select("_d", F.explode(parts_of(F.col("_v"))).alias("_p"))
            .join(again.hint("merge"), (F.col("_p.part") == F.col("part")) & (F.col("_p.id") == F.col("id")))
            .groupBy("_d")
            .agg(F.collect_set(F.struct(F.concat_ws("|", "part", "id").alias("key"), F.col("attempt").alias("value"))).alias("_again"))
            .select("_d", F.map_from_entries("_again").alias("_again"))
        )
        marked = marked.withColumn("_digest", F.when(F.col("_found").isNotNull(), digest)).join(stash(affected, "affected").hint("merge"), F.col("_digest") == F.col("_d"), "left")
        attempt = lambda part, i: F.coalesce(F.try_element_at("_again", F.concat_ws("|", part, i)), F.lit(0))
    marked = marked.withColumn("_made", F.transform("_found", lambda v: surrogate(v, key, attempt)))
    between = F.split(F.col("_text"), ENTITY, -1)
    replaced = F.when(
        F.col("_found").isNotNull(),
        F.array_join(F.zip_with(between, F.concat("_made", F.array(F.lit(""))), lambda text, made: F.concat(text, made)), ""),
    ).otherwise(F.col("_text"))
    out = [replaced.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns]
    return marked.select(*out, F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_entities"))


def op6_surrogates(spark, sf_dir):
    """The registered query: all ``documents`` with their entities replaced."""
    key = spark.conf.get(KEY_SETTING, None) or TEST_KEY
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)

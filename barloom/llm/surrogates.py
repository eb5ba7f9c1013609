"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

An entity is found by its shape and brought to a canonical form, so that the same number in another layout or an
address in capitals is the same entity. A surrogate of the same kind is made from a keyed hash: numbers keep their
layout and check digits, names their script and gender, secrets their alphabet. No two entities get one surrogate,
and no surrogate is an entity of the corpus: whoever loses such a collision is hashed again.

A name is found behind a title, behind words that announce one, or by a given name of the lists; a family name that a
document has in one of these ways is found wherever else it stands in that document. A person's gender in a document
is what any title there says of the name, else what the lists say.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, free_name, join_hot

#: the session's setting with the key of surrogates
KEY_SETTING = "spark.barloom.surrogates.key"

# fixed values: words before names, and given names, by gender
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
OTHER_TITLES = ["Dr", "Prof"]
#: words that announce a given and a family name
CONTEXTS = [
    "name is",
    "Name:",
    "Author:",
    "Signed:",
    "signed by",
    "Regards,",
    "Sincerely,",
    "heiße",
    "Autor:",
    "m'appelle",
    "Nom :",
    "me llamo",
    "Nombre:",
    "Имя:",
]
GIVEN = {
    "m_l": [
        "Albert", "Alexander", "Andreas", "Andrew", "Anthony", "Antonio", "Bernard", "Carlos", "Christian", "Charles", "Daniel",
        "David", "Diego", "Edward", "Etienne", "Fernando", "Francisco", "Frederic", "George", "Gerhard", "Guillaume", "Heinrich",
        "Hans", "Henry", "Jacques", "James", "Javier", "Jean", "Johannes", "John", "Jorge", "Joseph", "Juan", "Klaus", "Karl",
        "Laurent", "Leonard", "Louis", "Luis", "Manuel", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Nicolas", "Pablo",
        "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Rafael", "Richard", "Robert", "Stefan", "Thomas", "Vincent",
        "William", "Wolfgang",
    ],
    "f_l": [
        "Adele", "Alexandra", "Alice", "Amelie", "Andrea", "Angela", "Anna", "Barbara", "Beatrice", "Camille", "Carmen",
        "Caroline", "Catherine", "Charlotte", "Christine", "Claudia", "Dorothea", "Eleanor", "Elena", "Elizabeth", "Emilia",
        "Emily", "Emma", "Florence", "Francesca", "Gabriela", "Helene", "Isabel", "Jacqueline", "Jane", "Jennifer", "Johanna",
        "Julia", "Juliette", "Katharina", "Leonora", "Laura", "Linda", "Lisa", "Louise", "Lucia", "Margaret", "Maria", "Marie",
        "Marta", "Mary", "Mathilde", "Patricia", "Rosalind", "Sabine", "Sarah", "Sofia", "Sophie", "Stephanie", "Susan",
        "Theresa", "Victoria",
    ],
    "m_c": [
        "Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Константин", "Михаил", "Николай",
        "Павел", "Сергей", "Юрий",
    ],
    "f_c": [
        "Александра", "Анастасия", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Надежда",
        "Наталья", "Ольга", "Татьяна",
    ],
}
GIVEN |= {"n_l": GIVEN["m_l"] + GIVEN["f_l"], "n_c": GIVEN["m_c"] + GIVEN["f_c"]}
SYLLABLES = {
    "l": [
        "bar", "ben", "cal", "dor", "el", "fen", "gar", "hol", "ist", "kar", "lan", "mar", "nor", "ol", "per", "ran", "sel",
        "tor", "ul", "ven", "win", "zel", "ber", "den", "gen", "ler", "man", "ner", "ser", "ten", "ver", "wal",
    ],
    "c": [
        "ба", "бе", "во", "га", "де", "жу", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "но", "па", "по", "ра", "ро", "са",
        "со", "та", "то", "фе",
    ],
}

_TITLES = "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
_CONTEXTS = "|".join(CONTEXTS)
_GIVEN = "|".join(sorted({*GIVEN["n_l"], *GIVEN["n_c"]}))
_NAME_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: contexts in lower case: a text has one of them, or a pattern without them does
_WORDS = [c for c in CONTEXTS if c[0].islower()]


# each pattern looks at the one sign at hand before it looks around
def _name(contexts: list[str]) -> str:
    first = "".join(sorted({x[0] for x in [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, *contexts, *GIVEN["n_l"], *GIVEN["n_c"]]}))
    return (
        rf"(?=[{first}])(?<!\p{{L}})(?:(?:{_TITLES})\.? {_NAME_WORD}(?: {_NAME_WORD})?|(?:{'|'.join(contexts)})\s(?!(?:{_TITLES})\b){_NAME_WORD} {_NAME_WORD}|(?:{_GIVEN}) {_NAME_WORD})(?!\p{{L}})"
    )


#: what stands before the words of a name
_LEAD = rf"(?:(?:{_TITLES})\.? |(?:{_CONTEXTS})\s)"
EMAIL = r"(?=[\p{L}\p{N}._%+\-])(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
# a dotted end belongs to the address, but behind ::ffff: it is an IPv4 address by itself
_END = rf"(?:(?:{_OCTET}\.){{3}}{_OCTET}|{_HEX})(?!\w|:|\.\d)"
_SHORT = "|".join(
    [
        *[rf"(?:{_HEX}:){{{n}}}(?::{_HEX}){{0,{6 - n}}}:{_END}" for n in range(1, 7)],
        rf":(?::{_HEX}){{0,6}}:{_END}",
        rf"(?:{_HEX}:){{1,7}}:(?![\w:])",
    ]
)
# short forms have a digit or are of the local networks (other words around '::' are code), and are no steps of a slice
IPV6 = rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![\w:])(?:(?:{_HEX}:){{7}}{_HEX}(?![\w:])|(?:{_HEX}:){{6}}(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)|(?<![\w)\]]\[)(?=[0-9A-Fa-f:]{{0,38}}::)(?=[A-Fa-f:]{{0,38}}\d|[Ff][CcDd][0-9A-Fa-f]{{2}}:)(?!::[Ff]{{4}}:\d+\.)(?:{_SHORT}))"
SSN = r"(?=\d)(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
CARD = r"(?=[2-6])(?<![\w.\-])(?:(?:222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}|[3-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7})(?!\w)"
# lengths of account numbers by country; others are taken up to the last group
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?=[A-Z]{{2}}\d)(?<!\w)(?:(?:{_BY_COUNTRY})(?!\w)|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w))"
PHONE = r"(?=[+(\d])(?<![\w+])(?:(?:\+?1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|(?:\+?1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:(?:[ .\-]?\d{3,4}){1,3}|(?:[ .\-]?\d{2}){2,5}))(?!\w|\.\d)"
SECRET = r"(?=[Ags])(?<!\w)(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?!\w)|(?<=[=:][\"' ]{0,3})(?=[^\s\"',;]{6})(?<=(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']{0,1} {0,2}[=:] {0,2}[\"']{0,1})[^\s\"',;]{6,}+"
ENTITY = "|".join([EMAIL, IPV4, IPV6, SSN, CARD, IBAN, PHONE, SECRET, _name(CONTEXTS)])
#: the same for texts without one of _WORDS
PLAIN = "|".join([EMAIL, IPV4, IPV6, SSN, CARD, IBAN, PHONE, SECRET, _name([c for c in CONTEXTS if c not in _WORDS])])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "")


def _chars(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1)))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + acc["odd"])
        return F.struct((acc["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (1 - acc["odd"]).alias("odd"))

    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")), step, lambda a: a["sum"] % 10)


def mod97(s: Column) -> Column:
    """An IBAN rearranged, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(moved), F.lit(0), step)


def kind_of(m: Column, families: Column | None = None) -> Column:
    """What a found string is; null if its check digits say that it is none. ``families`` are the document's known
    family names in lower case."""
    known = F.lit(False) if families is None else F.array_contains(families, F.lower(m))
    n = F.length(_digits(m))
    return (
        F.when(m.rlike(r"^[^@\s]+@[^@\s]+\.\p{L}+$"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(m.rlike(rf"^(?:{IPV6})$"), "ipv6")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(known | m.rlike(rf"^(?:{_LEAD}|(?:{_GIVEN}) )\p{{Lu}}"), "name")
        .when(m.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]{4}[ A-Z0-9]+$"), F.when(mod97(_alnum(m)) == 1, "iban"))
        .when(m.rlike(r"^[2-6]\d{3}[\d \-]+$") & n.between(13, 19), F.when(luhn_sum(_digits(m)) == 0, "card"))
        .when(m.rlike(r"^[+(\d][\d ().\-]+$") & m.rlike(r"[^\d]"), F.when(n >= 7, "phone"))
        .otherwise("secret")
    )


def whole_ipv6(m: Column) -> Column:
    """An IPv6 address as eight groups of four digits."""

    def groups(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda x: x != "")

    low = F.lower(m)
    octets = F.split(F.regexp_extract(low, r"[\d.]+$", 0), r"\.")
    pair = lambda i: F.hex(F.get(octets, F.lit(i)).try_cast("int") * 256 + F.get(octets, F.lit(i + 1)).try_cast("int"))
    low = F.when(F.contains(low, F.lit(".")), F.lower(F.concat(F.regexp_replace(low, r"[\d.]+$", ""), pair(0), F.lit(":"), pair(2)))).otherwise(low)
    halves = F.split(low, "::")
    head, tail = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    whole = F.concat(head, F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail)), tail)
    return F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ":")


def _words(m: Column) -> Column:
    """The words of a found name: given and family name, or the family name alone."""
    return F.split(F.regexp_replace(m, rf"^{_LEAD}", ""), " ")


def _title_gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\.? "), "m").when(m.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? "), "f")


def families_of(names: Column) -> Column:
    """The family names of found names, in lower case."""
    return F.array_distinct(F.transform(names, lambda m: F.lower(F.element_at(_words(m), -1))))


def gender_of(m: Column, names: Column) -> Column:
    """m, f or n for a found name: by its own title, by a title that the document gives the same full name, then the
    same given name, elsewhere, at last by the lists."""

    def told(key) -> Column:
        said = lambda g: F.exists(names, lambda x: _title_gender(x).eqNullSafe(F.lit(g)) & key(x).eqNullSafe(key(m)))
        return F.when(said("m") & ~said("f"), "m").when(said("f") & ~said("m"), "f")

    first = lambda x: F.when(F.size(_words(x)) > 1, F.lower(_words(x)[0]))
    given = F.initcap(_words(m)[0])
    listed = F.when(given.isin(GIVEN["m_l"] + GIVEN["m_c"]), "m").when(given.isin(GIVEN["f_l"] + GIVEN["f_c"]), "f")
    return F.coalesce(_title_gender(m), told(lambda x: F.lower(F.array_join(_words(x), " "))), told(first), listed, F.lit("n"))


def entities_of(m: Column, kind: Column, gender: Column) -> Column:
    """The entities of a found string as an array of (kind, canonical form); a name has one for each word."""

    def one(k: str | Column, canon: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), canon.alias("canon"))

    script = F.when(m.rlike(r"\p{IsCyrillic}{2}"), "c").otherwise("l")
    words = _words(m)
    family = F.concat(F.lit("family_"), script)
    name = F.when(F.size(words) > 1, F.array(one(F.concat(F.lit("given_"), gender, F.lit("_"), script), F.lower(words[0])), one(family, F.lower(words[1])))).otherwise(F.array(one(family, F.lower(words[0]))))
    phone = F.regexp_replace(_digits(m), r"^1(?=\d{10}$)", "")
    return (
        F.when(kind == "name", name)
        .when(kind == "email", F.array(one("email", F.lower(m))))
        .when(kind == "phone", F.array(one("phone", phone)))
        .when(kind.isin("card", "ssn"), F.array(one(kind, _digits(m))))
        .when(kind == "iban", F.array(one("iban", _alnum(m))))
        .otherwise(F.array(one(kind, F.when(kind == "ipv6", whole_ipv6(m)).otherwise(m))))
    )


def _mapped(canon: Column, digest: Column, letters: Column | int = 26, kept: Column | int = 0) -> Column:
    """Digits for digits and letters for letters of the same case by the digest's bytes; the first ``kept`` stay."""

    def change(c: Column, i: Column) -> Column:
        b = F.conv(F.substring(digest, 2 * F.pmod(i, F.lit(60)) + 1, F.lit(2)), 16, 10).cast("int")
        return (
            F.when(i < kept, c)
            .when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.char(65 + b % letters))
            .when(c.rlike(r"\p{L}"), F.char(97 + b % letters))
            .otherwise(c)
        )

    # secrets have no greatest length, so no sign is looked up by its place
    return F.array_join(F.transform(F.split(canon, ""), change), "")


def surrogate(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """The surrogate of an entity in its canonical form."""
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, canon, F.lit(str(attempt))), 512)

    def number(i: int) -> Column:
        return F.conv(F.substring(digest, 8 * i + 1, 7), 16, 10).cast("int")

    def chosen(words: list[str], i: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), number(i) % len(words) + 1)

    names = {f"given_{g}": F.concat_ws("-", *[chosen(ws, i) for i in range(min(1 + attempt // 2, 8))]) for g, ws in GIVEN.items()}
    names |= {f"family_{s}": F.initcap(F.concat(*[chosen(ws, i) for i in range(min(2 + attempt // 3, 12))])) for s, ws in SYLLABLES.items()}
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    second = F.sha2(digest, 512)
    email = F.concat(_mapped(local, digest), F.lit("@"), _mapped(rest, second), F.lit("."), top)
    ipv4 = F.concat_ws(".", *[(number(i) % (223 if i == 0 else 254) + 1).cast("string") for i in range(4)])
    ipv6 = F.concat(F.substring(canon, 1, 1), F.substring(F.regexp_replace(F.substring(digest, 1, 32), "(.{4})(?=.)", "$1:"), 2, 38))
    first = F.when(F.substring(canon, 1, 1) == "2", F.concat(F.lit("2"), (3 + number(9) % 4).cast("string"))).otherwise(
        F.substring(canon, 1, 1)
    )
    body = F.concat(first, F.substring(_mapped(canon, digest), F.length(first) + 1, F.length(canon) - 1 - F.length(first)))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string"))
    raw = _mapped(canon, digest, kept=F.when(F.length(canon) > 10, 2).otherwise(0))
    ten = F.concat((2 + number(8) % 8).cast("string"), F.substring(raw, 2, 2), (2 + number(9) % 8).cast("string"), F.substring(raw, 5, 6))
    account = F.concat(F.substring(canon, 1, 2), F.lit("00"), F.substring(_mapped(canon, digest), F.lit(5), F.length(canon)))
    iban = F.concat(
        F.substring(canon, 1, 2), F.lpad((98 - mod97(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account))
    )
    secret = _mapped(
        canon,
        digest,
        F.when(canon.rlike("^[0-9a-f]+$"), 6).otherwise(26),
        F.length(F.regexp_extract(canon, "^(A[KS]IA|gh[pousr]_|sk-)?", 0)),
    )
    out = F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", card).when(kind == "iban", iban)
    out = (
        out.when(kind == "phone", F.when(F.length(canon) == 10, ten).otherwise(raw))
        .when(kind == "ssn", _mapped(canon, digest))
        .when(kind == "ipv6", ipv6)
    )
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), names.items(), out).otherwise(secret)


def laid_out(m: Column, kind: Column, cores: Column) -> Column:
    """A found string with the surrogates of its entities in its own layout."""

    def refill(core: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            fill = c.rlike("[0-9A-Za-z]") & (acc["k"] < F.length(core))
            return F.struct(
                F.concat(F.when(fill, F.substring(core, F.length(core) - acc["k"], F.lit(1))).otherwise(c), acc["out"]).alias("out"),
                (acc["k"] + fill.cast("int")).alias("k"),
            )

        return F.aggregate(_chars(F.reverse(m)), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda a: a["out"])

    title = F.regexp_extract(m, rf"^{_LEAD}?", 0)
    return (
        F.when(kind == "name", F.concat(title, F.array_join(cores, " ")))
        .when(kind.isin("phone", "card", "ssn", "iban"), refill(cores[0]))
        .when(kind.isin("email", "ipv6") & (m == F.upper(m)) & (m != F.lower(m)), F.upper(cores[0]))
        .otherwise(cores[0])
    )


def _space(kind: Column) -> Column:
    """Kinds in which surrogates must differ: given names of a script are one, whatever their gender."""
    return F.regexp_replace(kind, "^given_[mfn]_", "given_")


def assign(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, canon, core): a surrogate for each entity, unlike all other surrogates and all entities of its space.

    Names grow with the rounds, numbers keep their length: where a kind has more entities than its numbers, a few
    rounds without a winner end in an error.
    """
    left, done, idle, attempt = entities.select("kind", "canon"), None, 0, 0
    same = (F.col("space") == F.col("_k")) & (F.col("low") == F.col("_c"))
    taken = entities.select(_space(F.col("kind")).alias("_k"), F.lower("canon").alias("_c")).distinct()
    while True:
        made = left.withColumn("core", surrogate(F.col("kind"), F.col("canon"), attempt, key)).withColumns(
            {"low": F.lower("core"), "space": _space(F.col("kind"))}
        )
        free = made.join(taken, same, "left_anti")
        if done is not None:
            free = free.join(done.select(_space(F.col("kind")).alias("_k"), F.lower("core").alias("_c")), same, "left_anti")
        won = free.groupBy("space", "low").agg(F.min_by(F.struct("kind", "canon", "core"), F.struct("canon", "kind")).alias("w"))
        won = scratch.keep(won.select("w.kind", "w.canon", "w.core"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = scratch.keep(left.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "left")
        if left.isEmpty():
            return done
        attempt, idle = attempt + 1, idle + 1 if won.isEmpty() else 0
        if idle > 8:
            raise RuntimeError(
                f"no surrogates are left for {left.count()} entities of the kinds {sorted(r.kind for r in left.select('kind').distinct().collect())}"
            )


def key_of(spark: SparkSession) -> str:
    """The session's key of surrogates; a key of this call alone where none is set, so that nobody can repeat it."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def replace_entities(
    docs: DataFrame, scratch: Scratch, key: str, doc_id: str = "doc_id", text: str = "text", count: str = "n_entities"
) -> DataFrame:
    """docs with surrogates in ``text`` and the number of replaced strings in ``count``, in place of a column of that
    name.

    Texts without entities pass as they are, null ones too. Rows that repeat get the same surrogates. An entity
    that holds a share of all finds is joined by broadcast, which has at most a thousand rows.
    """
    if not key:
        raise ValueError("surrogates need a key")
    docs = docs.drop(count)
    found_, key_, of_, cores_, text_, known_ = (free_name(x, docs.columns) for x in ("_found", "_key", "_of", "_cores", "_text", "_known"))
    body = F.col(f"`{text}`")
    wordy = reduce(lambda a, b: a | b, [F.contains(body, F.lit(c)) for c in _WORDS])
    found = F.when(wordy, F.regexp_extract_all(body, F.lit(ENTITY), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(PLAIN), F.lit(0)))
    tagged = docs.withColumn(found_, found)
    # family names that the document has with a title, a context or a given name
    names = F.filter(found_, lambda m: kind_of(m) == "name")
    tagged = tagged.withColumn(
        known_, F.when(F.exists(found_, lambda m: m.rlike(rf"^(?:{_LEAD}|(?:{_GIVEN}) )\p{{Lu}}")), families_of(names))
    )
    base = scratch.keep(
        tagged.withColumn(
            key_, F.concat_ws(":", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.xxhash64(text).cast("string"))
        ),
        "found",
    )
    # the patterns run once over the texts, and once more over those with names
    alone = F.array_join(F.transform(known_, lambda w: F.initcap(F.replace(w, F.lit("-"), F.lit(" ")))), "|")
    alone = F.replace(alone, F.lit(" "), F.lit("-"))
    pattern = F.concat(F.lit(ENTITY + r"|(?<!\p{L}|\p{L}-)(?:"), alone, F.lit(r")(?!\p{L}|-\p{L})"))
    more = F.size(known_) > 0
    found = F.when(more, F.regexp_extract_all(body, pattern, F.lit(0))).otherwise(F.col(found_))
    tagged = base.filter(F.size(found_) > 0).withColumn(found_, found)
    names = F.filter(found_, lambda m: kind_of(m, F.col(known_)) == "name")

    def told(m: Column) -> Column:
        kind = F.when(more, kind_of(m, F.col(known_))).otherwise(kind_of(m))
        return F.struct(m.alias("m"), kind.alias("kind"), F.when(more & (kind == "name"), gender_of(m, names)).alias("gender"))

    has = F.coalesce(F.exists(found_, lambda x: x["kind"].isNotNull()), F.lit(False))
    some = scratch.keep(tagged.withColumn(found_, F.transform(found_, told)), "some")
    finds = some.filter(has).select(F.col(key_).alias("_key"), F.posexplode(found_).alias("pos", "x")).filter("x.kind is not null")
    finds = finds.select("_key", "pos", F.posexplode(entities_of(F.col("x.m"), F.col("x.kind"), F.col("x.gender"))).alias("part", "e"))
    finds = scratch.keep(finds.select("_key", "pos", "part", "e.kind", "e.canon"), "finds")
    entities = scratch.keep(finds.groupBy("kind", "canon").agg(F.count("*").alias("n")), "entities")
    total = entities.agg(F.sum("n")).first()[0] or 0
    cores = assign(entities, scratch, key).join(entities, ["kind", "canon"])
    name = F.concat_ws("\x01", "kind", "canon")
    joined = join_hot(
        finds.select("_key", "pos", "part", name.alias("_e")),
        cores.select(name.alias("_e"), "core", "n"),
        "_e",
        F.concat_ws(":", "_key", "pos", "part"),
        F.col("n") >= max(100, total // 1000),
    )
    words = joined.groupBy("_key", "pos").agg(F.sort_array(F.collect_set(F.struct("part", "core"))).alias("c"))
    lists = words.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col("c.core")))).alias(cores_))
    lists = lists.withColumnRenamed("_key", of_)

    both = some.filter(has).join(lists, F.col(key_) == F.col(of_))
    pieces = F.when(more, F.split(body, pattern, -1)).when(wordy, F.split(body, ENTITY, -1)).otherwise(F.split(body, PLAIN, -1))

    def put(piece: Column, i: Column) -> Column:
        x, own = F.get(found_, i), F.element_at(cores_, i)
        return F.concat(piece, F.coalesce(F.when(own.isNotNull(), laid_out(x["m"], x["kind"], own)), x["m"], F.lit("")))

    out = both.withColumn(text_, F.array_join(F.transform(pieces, put), "")).withColumn(count, F.size(cores_).cast("long"))
    changed = out.select(*[F.col(text_).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], count)
    own = [F.col(f"`{c}`") for c in docs.columns]
    same = base.filter(F.coalesce(F.size(found_) <= 0, F.lit(True))).select(*own).unionByName(some.filter(~has).select(*own))
    return same.select(*own, F.lit(0).cast("long").alias(count)).unionByName(changed)

"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, IP addresses of both versions, card and
account numbers, telephone numbers (3-3-4 and 3-2-4 digits, and 7 to 15 digits
in any grouping after a plus sign), access keys, secrets after their names, long
hexadecimal tokens, and names after a title. Numbers in the form of a card are
entities only if their check digit holds and they begin as cards do.

Numbers, addresses and secrets are replaced by surrogates of the same shape: a
keyed Feistel permutation shifts every character within its own alphabet
(digits, letters of one script and case, hexadecimal digits, whole octets of an
address). Check digits of cards and accounts follow the new number. Each word of
a name is drawn by a keyed hash from name tables of its script, given names also
by gender: that of the title, or else that of a known name or of its ending.
Feminine forms of Slavic family names stay feminine. Titles stay, and so does
letter case. Words in scripts without a table are permuted letter by letter.

The same entity gets the same surrogate in every document (coreference, also
over letter case and gaps; for names word by word). Distinctness: surrogates
that meet a real entity of the corpus or another surrogate are found by a join
and drawn anew until none does, or until every string of the shape is proven to
be taken; those exceptions are joined to the documents that hold them. Names
always have room, as further parts are added with each turn.

Edge cases: null texts stay null; empty texts and texts without entities are
returned as they are; repeated rows get equal results; entities of any length
take time in proportion; all columns stay, and ``n_chars``, where there is one,
follows the new text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import few, materialise, table

KEY = "symweave surrogates"
ROUNDS = 4
#: Attempts between two looks at which shapes are full; names get a further part as often.
LOOK = 4
#: Texts with exceptions that are broadcast (about 200 bytes each); beyond that they are joined by a shuffle, dealt by SALT.
BROADCAST_TEXTS, SALT = 100_000, 16
#: Marks entities in a text that is cut; a code point that is no character.
MARK = "\ufdd0"

#: Titles that introduce a name, by the gender they tell (fixed values).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Don", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "Госпожа"),
    "": ("Dr", "Prof"),
}
#: Given names by script and gender (fixed values).
GIVEN = {
    "latin-f": "Ada Agnes Alice Amelia Anna Beatrice Camille Carla Clara Daniela Diana Elena Elisa Emma Eva Flora Frida Gloria Greta Hanna Helen Ines Irene Isabel Julia Karin Laura Lena Lucia Lydia Maria Marta Monica Nadia Nora Olga Paula Petra Rosa Ruth Sabine Sarah Silvia Sofia Stella Susanne Teresa Ursula Vera Yvonne".split(),
    "latin-m": "Adam Albert Andrew Anton Arthur Benjamin Bruno Carlos Daniel David Dieter Diego Edgar Erik Felix Frank George Gustav Henry Hugo Ivan Jakob James Jorge Julian Karl Kurt Leon Louis Lukas Marco Martin Michel Nicolas Oscar Otto Pablo Paul Peter Philip Ralph Robert Simon Stefan Thomas Tobias Victor Walter William Xavier".split(),
    "cyrillic-f": "Алина Алла Анна Вера Галина Дарья Елена Зоя Инна Ирина Кира Лариса Лидия Людмила Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Светлана София Тамара Татьяна Ульяна Юлия Яна".split(),
    "cyrillic-m": "Алексей Андрей Антон Борис Вадим Виктор Владимир Геннадий Глеб Григорий Денис Дмитрий Евгений Егор Иван Игорь Кирилл Леонид Максим Михаил Николай Олег Павел Пётр Роман Сергей Степан Тимур Фёдор Юрий".split(),
}
#: Beginnings and endings that family names are made of (fixed values).
FAMILY = {
    "latin": ("Ash Bar Berg Birch Black Bran Bright Brook Burn Clay Cole Dal Eich Elm Fair Falk Fern Gold Green Hag Hart Hazel Hill Holm Kings Lang Lin Marl Mont Nor Oak Old Rain Red Rich Ros Sand Shel Stan Stein Stone Thorn Wal Wes White Wil Win Wolf".split(), "bach berg borne burg bury dale feld field ford gate ham hart haus hurst land ley man mann mark mere mont more ner ridge son stein ton vale ville wald ward well wood worth".split()),
    "cyrillic": ("Алёш Барсук Бел Берёз Богдан Ветр Волк Воробь Ворон Гаврил Голуб Горбат Гром Гусар Дорон Ермол Жар Журавл Завьял Зайц Звер Зимар Кабан Калаш Климент Ковал Козл Колос Комар Крыл Лавр Лебед Логин Макар Медвед Морозк Наум Орл Павл Пестр Полян Прохор Рыбак Рябин Савел Сокол Соболь Тарас Тихон Фадей".split(), ["ов", "ин"]),
}
#: Alphabets within which characters are shifted (fixed values).
ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "AEIOU",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ",
    "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŸŒ",
    "çñß",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEX = "0123456789abcdef"
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_GAP = r"[\s.#%&*$!-]{0,4}"
_EVERY_TITLE = [t for group in TITLES.values() for t in group]
_TITLE = "(?=[DFHMPSГ])(?:" + "|".join([*_EVERY_TITLE, *(t.upper() for t in _EVERY_TITLE)]) + r")\.?\s"
_WORD = r"\p{Lu}\p{L}++(?:['’-]\p{L}++)*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_H = "[0-9a-fA-F]{1,4}"
_TAIL = rf"(?:(?:{_OCTET}\.){{3}}{_OCTET}|{_H})"
#: Every group that repeats without a bound is possessive: Java keeps no stack for those, however long the text.
PATTERNS = {
    "email": r"(?<![a-zA-Z0-9._%+\p{L}\p{N}-])[a-zA-Z0-9._%+\p{L}\p{N}-]++@[a-zA-Z0-9\p{L}\p{N}-]++(?:\.[a-zA-Z0-9\p{L}\p{N}-]++)++",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{6,7}}{_TAIL}|{_H}(?::{_H}){{0,6}}::(?:(?:{_H}:){{0,6}}{_TAIL})?|::(?:{_H}:){{0,6}}{_TAIL})(?![\p{{L}}\p{{N}}:]|\.\d)",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![\p{L}\p{N}])" + _NAMES + r"\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_/+.-]{6,}+",
    "hex": r"(?<![\p{L}\p{N}])(?=[a-fA-F]*+\d)(?=\d*+[a-fA-F])[0-9a-fA-F]{18,}+(?![\p{L}\p{N}])",
    "phone": rf"(?<![\p{{L}}\d])\+?\d{{1,3}}{_GAP}\(\d{{2,4}}\){_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)|(?<![\p{{L}}\d])(?:\+\d{{1,3}}[ .-])?\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}(?!\d)|(?<!\d)\d{{3}}-\d{{2}}-\d{{4}}(?!\d)|(?<![\p{{L}}\d+])\+\d(?:[ .()/-]{{0,3}}\d){{6,14}}(?!\d)",
    "card": r"(?<![\p{L}\d])(?:[2-6]\d{12,18}|[2-6]\d{3}(?: \d{4}){3}|[2-6]\d{3}(?:-\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{4,5})(?![\p{L}\d])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "person": rf"(?<!\p{{L}}){_TITLE}{_WORD}(?:\s{_WORD})?",
}

def _any(*names: str) -> str:
    return "|".join(PATTERNS[n] for n in names)


#: No entity begins inside a word: that test comes first, as it turns most places of a text away. Then the first character says what may begin.
PATTERN = (
    r"(?<![a-zA-Z\p{L}])(?:(?=[\d+(:])(?:" + _any("email", "ip", "ipv6", "hex", "phone", "card") + ")"
    r"|(?=[a-zA-Z\p{L}])(?:" + _any("email", "ipv6", "key", "secret", "hex", "iban", "person") + ")"
    r"|(?=[\p{N}._%-])(?:" + _any("email") + "))"
)
#: Texts without any of these hold no entity: each pattern asks for an at sign, a colon or an equals sign, a plus sign, a title,
#: the beginning of a key, or a digit beside another, beside a point or beside a hexadecimal letter.
HINT = r"[@=:+]|\d[\d.a-fA-F]|[a-fA-F]\d|A[KS]IA|" + _TITLE

_SECRET_HEAD = r"^[^=:]*[=:]\s*[\"']?"
_SHIFTED = ("email", "ip", "ipv6", "key", "secret", "hex", "phone", "card", "iban", "letters")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(words) -> Column:
    """A constant array; one literal, as a plan is built from few of them faster."""
    return F.split(F.lit(" ".join(words)), " ")


def _full(name: str) -> str:
    return "^(?:" + PATTERNS[name] + ")$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The check digit of a string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)), F.lit(10))


def _remainder97(text: Column) -> Column:
    """A string of digits and capitals, letters read as 10 to 35, as a number modulo 97."""
    value = lambda c: F.position(c, F.lit(_ALNUM)) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.pmod(F.when(value(c) > 9, s * 100).otherwise(s * 10) + value(c), F.lit(97)).cast("int"))


def is_card(digits: Column) -> Column:
    """Whether a number of 13 to 19 digits begins as card numbers do and its check digit holds."""
    return digits.rlike(r"^(?:[3-6]|2[2-7])\d{12,18}$") & (F.right(digits, F.lit(1)).cast("int") == _luhn(digits.substr(F.lit(1), F.length(digits) - 1)))


def kind_of(m: Column) -> Column:
    """The type of what the pattern found, told by its form; null for numbers that only look like a card."""
    found = F.when(m.contains("@") & m.rlike(_full("email")), "email")
    for name in ("ip", "ipv6", "key", "secret", "person", "iban"):
        found = found.when(m.rlike(_full(name)), name)
    return found.when(m.rlike(r"^[\d -]+$") & (F.length(_digits(m)) >= 13), F.when(is_card(_digits(m)), "card")).when(m.rlike("^[0-9a-fA-F]+$"), "hex").otherwise("phone")


# ---- numbers, addresses, secrets: permutations within a shape ----------------


def _permute(values: Column, sizes: Column, key: Column) -> Column:
    """A keyed permutation of an array of numbers, each below its own size: a Feistel network over its halves."""

    def halves(x: Column) -> Column:
        half = F.floor(F.size(x["v"]) / 2).cast("int")
        rest = F.size(x["v"]) - half
        return F.struct(F.slice(x["v"], F.lit(1), half).alias("a"), F.slice(x["v"], half + 1, rest).alias("b"), F.slice(x["s"], F.lit(1), half).alias("m"), F.slice(x["s"], half + 1, rest).alias("n"))

    def turn(s: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, r.cast("string"), F.size(s["a"]).cast("string"), F.array_join(F.transform(s["b"], lambda x: x.cast("string")), ",")), 256)
        shifted = _let(stream, lambda h: F.transform(s["a"], lambda v, i: F.pmod(v + F.conv(F.substring(h, (i % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int"), F.get(s["m"], i)).cast("int")))
        return F.struct(s["b"].alias("a"), shifted.alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    return _let(F.struct(values.alias("v"), sizes.alias("s")), lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves(x), turn, lambda s: F.concat(s["a"], s["b"])))


def alphabets_of(entity: Column, kind: Column) -> Column:
    """For each character the alphabet that it is shifted in; the character itself where it stays."""
    head = F.when(kind.isin("key", "iban"), 4).otherwise(0)
    stop = F.when(kind == "email", F.length(entity) - F.length(F.regexp_extract(entity, r"\.[^.]*$", 0))).when(kind == "card", F.length(entity) - 1).otherwise(F.length(entity))
    dotted = F.when(kind == "ipv6", F.length(entity) - F.length(F.regexp_extract(entity, r"[^:]*\.[^:]*$", 0)))  # an IPv6 address may end in decimal octets
    hexed = kind.isin("hex", "ipv6") | ((kind == "secret") & entity.rlike("^[0-9a-f]+$"))
    bounds = F.struct(head.alias("head"), stop.alias("stop"), dotted.alias("dotted"), hexed.alias("hexed"))

    def among(b: Column, c: Column, i: Column) -> Column:
        own = F.when(b["hexed"] & F.contains(F.lit(HEX), c) & ~((kind == "ipv6") & (i >= b["dotted"])), F.lit(HEX)).otherwise(F.get(F.filter(_words(ALPHABETS), lambda a: F.contains(a, c)), F.lit(0)))
        return F.when((i < b["head"]) | (i >= b["stop"]), c).otherwise(F.coalesce(own, c))

    return _let(bounds, lambda b: F.transform(F.split(entity, ""), lambda c, i: among(b, c, i)))


def shifted(entity: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The surrogate, in canonical form, of an entity in canonical form: another string of its shape."""
    own = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"))
    octets = F.split(entity, r"\.")
    ip = F.array_join(F.transform(_permute(F.transform(octets, lambda o: o.cast("int")), F.transform(octets, lambda o: F.lit(256)), own), lambda v: v.cast("string")), ".")

    def spelled(alphabets: Column) -> Column:
        values = F.transform(F.split(entity, ""), lambda c, i: F.position(c, F.get(alphabets, i)) - 1)
        return F.array_join(F.transform(_permute(values, F.transform(alphabets, F.length), own), lambda v, i: F.substring(F.get(alphabets, i), v + 1, F.lit(1))), "")

    def card(text: Column) -> Column:
        body = text.substr(F.lit(1), F.length(text) - 1)
        last = F.pmod(F.right(entity, F.lit(1)).cast("int") - _luhn(entity.substr(F.lit(1), F.length(entity) - 1)) + _luhn(body), F.lit(10))
        return F.concat(body, last.cast("string"))

    def iban(text: Column) -> Column:
        turned = lambda t, check: F.concat(t.substr(F.lit(5), F.length(t)), t.substr(F.lit(1), F.lit(2)), check)
        left = _remainder97(turned(entity, entity.substr(F.lit(3), F.lit(2))))
        check = F.pmod(left - _remainder97(turned(text, F.lit("00"))), F.lit(97))
        return F.concat(text.substr(F.lit(1), F.lit(2)), F.lpad((check + F.when(check < 2, 97).otherwise(0)).cast("string"), 2, "0"), text.substr(F.lit(5), F.length(text)))

    text = _let(alphabets_of(entity, kind), spelled)
    return F.when(kind == "ip", ip).when(kind == "card", _let(text, card)).when(kind == "iban", _let(text, iban)).otherwise(text)


# ---- names: draws from tables -------------------------------------------------


def _draw(h: Column, at: Column, words: list[str]) -> Column:
    number = F.conv(F.substring(h, (F.pmod(at, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
    return F.get(_words(words), F.pmod(number, F.lit(len(words))).cast("int"))


#: How a kind of name word is made from the digits of a hash: its k-th part, and how many different parts there are.
NAME_KINDS: dict[str, tuple[Callable[[Column, Column], Column], int]] = {
    **{f"given-{k}": (lambda h, at, words=[w.lower() for w in v]: _draw(h, at, words), len(v)) for k, v in GIVEN.items()},
    **{f"family-{k}": (lambda h, at, a=[w.lower() for w in a], b=b: F.concat(_draw(h, at * 2, a), _draw(h, at * 2 + 1, b)), len(a) * len(b)) for k, (a, b) in FAMILY.items()},
}


def parts_needed(kind: str, words: int) -> int:
    """Parts of a name so that half of the names or more stay free."""
    room, parts = NAME_KINDS[kind][1], 1
    while room**parts < 2 * words and parts < 8:
        parts += 1
    return parts


def name_units(m: Column) -> Column:
    """The words of a name after its title as array<struct<kind,entity>>: entity in lower case, Slavic family names in masculine form."""
    title = F.lower(F.regexp_extract(m, r"^\p{L}+", 0))
    gender = F.when(F.array_contains(_words(t.lower() for t in TITLES["m"]), title), "m").when(F.array_contains(_words(t.lower() for t in TITLES["f"]), title), "f").otherwise("")
    words = F.regexp_extract_all(F.regexp_replace(m, "^" + _TITLE, ""), F.lit(r"\p{L}[\p{L}'’-]*"), F.lit(0))

    def known(w: Column, script: str) -> Column:
        among = lambda g: F.array_contains(_words(x.lower() for x in GIVEN[f"{script}-{g}"]), w)
        return F.when(among("f"), "f").when(among("m"), "m")

    def unit(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"^[\p{IsLatin}'’-]+$"), "latin").when(w.rlike(r"^[\p{IsCyrillic}-]+$"), "cyrillic")
        table_ = F.when(script == "latin", known(w, "latin")).when(script == "cyrillic", known(w, "cyrillic"))
        first = (F.size(words) > 1) & (i == 0)
        of = F.when(first, F.coalesce(F.when(gender != "", gender), table_, F.when(w.rlike("[aeая]$"), "f").otherwise("m"))).otherwise(table_)
        kind = F.when(script.isNull(), "letters").when(of.isNotNull(), F.concat(F.lit("given-"), script, F.lit("-"), of)).otherwise(F.concat(F.lit("family-"), script))
        return F.struct(kind.alias("kind"), F.when(kind == "family-cyrillic", F.regexp_replace(w, "(?<=[оеё]в|[иы]н)а$", "")).otherwise(w).alias("entity"))

    return F.transform(F.transform(words, F.lower), unit)


def drawn(entity: Column, kind: Column, attempt: Column, key: str, parts: dict[str, int]) -> Column:
    """The surrogate of one word of a name, in lower case."""

    def made(name: str) -> Column:
        count = F.lit(parts.get(name, 1)) + F.floor(attempt / LOOK).cast("int")
        number = F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), attempt.cast("string"), entity), 256)
        return _let(number, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda at: NAME_KINDS[name][0](h, at)), "-"))

    out = F.lit(None).cast("string")
    for name in NAME_KINDS:
        out = F.when(kind == name, made(name)).otherwise(out)
    return out


def spoken(word: Column, unit: Column, surrogate: Column) -> Column:
    """A name's surrogate in the letter case and gender of the word it stands for."""
    feminine = (unit["kind"] == "family-cyrillic") & F.lower(word).rlike("(?:[оеё]в|[иы]н)а$")
    full = F.when(feminine & surrogate.rlike("[вн]$"), F.concat(surrogate, F.lit("а"))).otherwise(surrogate)
    upper = (F.length(word) > 1) & (word == F.upper(word))
    return F.when(unit["kind"] == "letters", _cased(word, surrogate)).when(upper, F.upper(full)).otherwise(F.array_join(F.transform(F.split(full, "-"), F.initcap), "-"))


def _cased(m: Column, replacement: Column) -> Column:
    """A replacement of equal length in the letter case of the mention."""
    return F.array_join(F.zip_with(F.split(m, ""), F.split(replacement, ""), lambda c, r: F.when(c == F.lower(c), r).otherwise(F.upper(r))), "")


# ---- entities and texts --------------------------------------------------------


def secret_value(m: Column) -> Column:
    """A secret without the name that it follows."""
    return F.regexp_replace(m, _SECRET_HEAD, "")


def canonical(m: Column, kind: Column) -> Column:
    """What all mentions of one entity have in common: letter case, gaps and leading zeros of octets do not count."""
    return F.when(kind.isin("email", "hex", "ipv6"), F.lower(m)).when(kind.isin("phone", "card"), _digits(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "ip", F.regexp_replace(m, r"(?<!\d)0+(?=\d)", "")).otherwise(m)


def units_of(m: Column, kind: Column) -> Column:
    """The entities of one mention as array<struct<kind,entity>>: the words of a name, or the one entity that it is."""
    one = lambda k, e: F.array(F.struct(k.alias("kind"), e.alias("entity")))

    def of_secret(v: Column) -> Column:
        """A key or token is the same entity with and without a name before it."""
        own = F.when(v.rlike(_full("key")), "key").when(v.rlike("^(?=[a-fA-F]*+\\d)(?=\\d*+[a-fA-F])[0-9a-fA-F]{18,}+$"), "hex").otherwise("secret")
        return one(own, F.when(own == "hex", F.lower(v)).otherwise(v))

    return F.when(kind == "person", name_units(m)).when(kind == "secret", _let(secret_value(m), of_secret)).when(kind.isNotNull(), one(kind, canonical(m, kind))).otherwise(F.array().cast("array<struct<kind:string,entity:string>>"))


def first_surrogate(unit: Column, attempt: Column, key: str, parts: dict[str, int]) -> Column:
    return F.when(unit["kind"].isin(*_SHIFTED), shifted(unit["entity"], unit["kind"], attempt, key)).otherwise(drawn(unit["entity"], unit["kind"], attempt, key, parts))


def rendered(m: Column, kind: Column, units: Column, surrogates: Column) -> Column:
    """Canonical surrogates in the form of the mention: its gaps, its letter case, its title."""
    one = F.get(surrogates, F.lit(0))

    def spaced(kept: str) -> Column:
        """What is not ``kept`` stays where it is between the characters of the surrogate."""
        cut = F.split(F.regexp_replace(m, kept, MARK), MARK, -1)
        return F.array_join(F.zip_with(cut, F.split(one, ""), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")

    head, value = F.regexp_extract(m, _SECRET_HEAD, 0), secret_value(m)
    words = F.regexp_extract_all(F.regexp_replace(m, "^" + _TITLE, ""), F.lit(r"\p{L}[\p{L}'’-]*"), F.lit(0))
    named = F.concat(F.regexp_extract(m, "^" + _TITLE, 0), F.concat_ws("", F.transform(words, lambda w, i: F.concat(F.when(i > 0, F.regexp_extract(m, r"(\s)\S+$", 1)).otherwise(""), spoken(w, F.get(units, i), F.get(surrogates, i))))))
    secret = F.concat(head, F.when(F.get(units, F.lit(0))["kind"] == "hex", _cased(value, one)).otherwise(one))
    return F.when(kind.isin("phone", "card"), spaced(r"\d")).when(kind == "iban", spaced("[^ ]")).when(kind.isin("email", "hex", "ipv6"), _cased(m, one)).when(kind == "person", named).when(kind == "secret", secret).otherwise(one)


def pieces_of(text: Column) -> Column:
    """A text cut at what the pattern finds: plain, found, plain, ..., plain."""
    marked = F.split(F.regexp_replace(text, PATTERN, MARK + "$0" + MARK), MARK, -1)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    # a text that holds the mark itself is gone through twice
    twice = F.flatten(F.transform(F.split(text, PATTERN, -1), lambda p, i: F.when(i < F.size(found), F.array(p, F.get(found, i))).otherwise(F.array(p))))
    return F.when(~text.rlike(HINT), F.array(text)).when(text.contains(MARK), twice).otherwise(marked)


def matches(text: Column) -> Column:
    """All that the pattern finds in a text, in order."""
    return F.filter(pieces_of(text), lambda p, i: i % 2 == 1)


def entities(documents: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, entity) of all documents, entities in canonical form."""
    found = documents.where(F.col(text).rlike(HINT)).select(F.explode(F.array_distinct(matches(F.col(text)))).alias("m")).withColumn("k", kind_of(F.col("m")))
    return found.select(F.explode(units_of(F.col("m"), F.col("k"))).alias("u")).select("u.kind", "u.entity").distinct()


def meetings(first: DataFrame) -> DataFrame:
    """(kind, entity) whose surrogate is a real entity, or that of a lesser entity too."""
    both = first.select("kind", "other", "entity", F.lit(0).alias("real")).unionByName(first.select("kind", F.col("entity").alias("other"), F.lit(None).cast("string").alias("entity"), F.lit(1).alias("real")))
    held = both.groupBy("kind", "other").agg(F.min("entity").alias("least"), F.max("real").alias("real"), F.count("entity").alias("n")).where("n > 0 and (real = 1 or n > 1)")
    return first.join(held, ["kind", "other"]).where("real = 1 or entity <> least").select("kind", "entity")


def full_shapes(bad: DataFrame, taken: DataFrame) -> DataFrame:
    """The (kind, entity) of ``bad`` for which every string of their shape is taken."""

    def shaped(df: DataFrame, of: str) -> DataFrame:
        alphabets = alphabets_of(F.col(of), F.col("kind"))
        return df.where(F.col("kind").isin(*_SHIFTED) & (F.col("kind") != "ip")).withColumn("shape", F.array_join(alphabets, "\n")).withColumn("room", F.aggregate(F.transform(alphabets, F.length), F.lit(1.0).cast("double"), lambda s, n: s * n))

    used = shaped(taken.distinct(), "other").groupBy("kind", "shape").agg(F.count("*").alias("used"))
    return shaped(bad, "entity").join(used, ["kind", "shape"]).where("used >= room").select("kind", "entity")


def exceptions(found: DataFrame, key: str, parts: dict[str, int]) -> DataFrame | None:
    """(kind, entity, other) for entities whose first surrogate cannot stay, drawn anew; None where there is none."""
    files = few(found.sparkSession)
    surrogate = lambda attempt: first_surrogate(F.struct("kind", "entity"), F.lit(attempt), key, parts)
    first = materialise(found.withColumn("other", surrogate(0)), "surrogates", files=files)
    bad = materialise(meetings(first), "met", files=files)
    if bad.isEmpty():
        return None
    taken = first.select("kind", F.col("entity").alias("other")).unionByName(first.select("kind", "other"))
    settled, attempt = None, 0
    while not bad.isEmpty():
        attempt += 1
        tried = bad.withColumn("other", surrogate(attempt)).join(taken, ["kind", "other"], "left_anti")
        good = materialise(tried.groupBy("kind", "other").agg(F.min("entity").alias("entity")).select("kind", "entity", "other"), "settled", files=files)
        settled = good if settled is None else settled.unionByName(good)
        taken = taken.unionByName(good.select("kind", "other"))
        bad = bad.join(good, ["kind", "entity"], "left_anti")
        if attempt % LOOK == 0:
            # where the corpus and the surrogates fill a shape, the first permutation still keeps its entities distinct
            bad = bad.join(full_shapes(bad, taken), ["kind", "entity"], "left_anti")
        bad = materialise(bad, "met", files=files)
    return settled


def anonymise(documents: DataFrame, key: str = KEY, text: str = "text", counted: str | None = None) -> DataFrame:
    """``documents`` with surrogates in ``text``; ``counted`` names a further column with the number of mentions."""
    names = documents.columns
    found = materialise(entities(documents, text), "entities", files=few(documents.sparkSession))
    sizes = {r[0]: r[1] for r in found.groupBy("kind").count().collect()}  # one row a kind
    parts = {k: parts_needed(k, n) for k, n in sizes.items() if k in NAME_KINDS}
    again = exceptions(found, key, parts)
    rows = documents
    if again is None:
        rows = rows.withColumn("__o", F.lit(None).cast("map<string,string>"))
    else:
        # equal texts have equal exceptions: a text is known by 128 bits of hash
        mark = [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), F.col(text)).alias("__h2")]
        own = documents.where(F.col(text).rlike(HINT)).select(*mark, F.explode(F.array_distinct(matches(F.col(text)))).alias("__m")).withColumn("__k", kind_of(F.col("__m")))
        own = own.select("__h1", "__h2", F.explode(units_of(F.col("__m"), F.col("__k"))).alias("u")).select("__h1", "__h2", "u.kind", "u.entity").distinct()
        pair = F.struct(F.concat_ws("|", "kind", "entity").alias("k"), F.col("other").alias("v"))
        held = materialise(own.join(again, ["kind", "entity"]).groupBy("__h1", "__h2").agg(F.map_from_entries(F.collect_list(pair)).alias("__o")), "exceptions", files=few(documents.sparkSession))
        rows = rows.select("*", *mark)
        if held.count() <= BROADCAST_TEXTS:  # texts then stay where they are
            rows = rows.join(F.broadcast(held), ["__h1", "__h2"], "left")
        else:  # copies of one text are dealt over tasks
            rows = rows.withColumn("__s", F.pmod(F.xxhash64(*[c for c, t in documents.dtypes if "map<" not in t]), F.lit(SALT)))
            rows = rows.join(held.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>"))), ["__h1", "__h2", "__s"], "left")

    def surrogate(u: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("__o"), F.concat_ws("|", u["kind"], u["entity"])), first_surrogate(u, F.lit(0), key, parts))

    def replaced(m: Column) -> Column:
        whole = lambda k: _let(units_of(m, k), lambda us: _let(F.transform(us, surrogate), lambda s: rendered(m, k, us, s)))
        return _let(kind_of(m), lambda k: F.when(k.isNull(), F.struct(m.alias("t"), F.lit(0).alias("n"))).otherwise(F.struct(whole(k).alias("t"), F.lit(1).alias("n"))))

    rows = rows.withColumn("__f", pieces_of(F.col(text)))
    rows = rows.withColumn("__n", F.transform("__f", lambda p, i: F.when(i % 2 == 1, replaced(p)).otherwise(F.struct(p.alias("t"), F.lit(0).alias("n")))))
    mentions = F.coalesce(F.aggregate("__n", F.lit(0), lambda s, x: s + x["n"]), F.lit(0))
    rows = rows.withColumn("__c", mentions).withColumn("__t", F.array_join(F.transform("__n", lambda x: x["t"]), ""))
    out = rows.withColumn(text, F.when(F.col("__c") > 0, F.col("__t")).otherwise(F.col(text)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__c") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    if counted:
        out = out.withColumn(counted, F.col("__c"))
    return out.select(*names, *([counted] if counted else []))


def op7_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), counted="n_entities")

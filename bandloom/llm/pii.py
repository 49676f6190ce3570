"""Personal data: keyed surrogates of the same type and format, in DataFrame and SQL functions only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.llm.shared import materialize, nested, with_lookup

#: Attempts after which numbers, whose formats have few values, get an extension that grows.
GROW = 16

# Titles by gender, and given names by script and gender.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Господин", "г-н"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "Госпожа", "г-жа"]
OPEN_TITLES = ["Mx", "Dr", "Prof", "доктор", "Доктор"]
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marc", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "n"): ["Alex", "Ariel", "Chris", "Dana", "Eden", "Jamie", "Jules", "Kim", "Luca", "Max", "Nico", "Robin", "Sam", "Sascha", "Toni", "Yael"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Фёдор"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Марина", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Лёша", "Миша", "Коля", "Витя", "Петя", "Гена", "Боря", "Юра", "Костя", "Лёня"],
}

PARTICLES = "de da do dos del della di du la le van von der den ten ter zu af av el al bin ibn".split()
HONORIFICS = ["さん", "様", "先生", "女士", "氏", "씨", "님"]

# Groups that repeat without a bound are possessive: the matcher loops over them and never recurses.
_EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@(?=[\p{L}\p{M}\p{N}.\-]*\.\p{L}{2})[\p{L}\p{N}][\p{L}\p{M}\p{N}\-]*+(?:\.[\p{L}\p{N}][\p{L}\p{M}\p{N}\-]*+)++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\w)"
_GROUP = "[0-9A-Fa-f]{1,4}"
_SHORT = rf"(?:{_GROUP}(?::{_GROUP}){{1,6}}|f[cd][0-9A-Fa-f]{{2}}|fe80|[23][0-9A-Fa-f]{{3}})::(?:{_GROUP}(?::{_GROUP}){{0,5}})?"
_HEX = rf"(?<![\w:\-])(?:(?:{_GROUP}:){{7}}{_GROUP}|{_SHORT}|(?:[0-9A-Fa-f]{{2}}:){{5}}[0-9A-Fa-f]{{2}}|(?:[0-9A-Fa-f]{{2}}-){{5}}[0-9A-Fa-f]{{2}})(?![\w:\-])"
_IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_CARD = r"(?<![\w.+\-])[2-6](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]|[.\-][0-9])"
_SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
_PHONE = r"(?<![\w+.\-])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}|[0-9]{3}([\-.])[0-9]{3}\1[0-9]{4})(?!\w)"
_TITLES = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES) + ")"
_CAP = r"[\p{Lu}\p{Lo}][\p{L}\p{M}]++(?:['’]\p{Lu}[\p{L}\p{M}]++)?|\p{Lu}['’]\p{Lu}[\p{L}\p{M}]++"
_PART = rf"(?:{_CAP})(?:-(?:{_CAP})){{0,3}}"
_NAME = rf"(?<![\w\-])(?:{_TITLES}\.? ){{1,3}}(?:(?:{_PART}|\p{{Lu}}\.) ){{0,2}}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_PART}(?!\w)"
_CALLED = rf"(?<!\w)[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}]{{1,6}}?(?:{'|'.join(HONORIFICS)})(?!\w)"
#: Everything that is replaced, in one pattern, so that entities don't overlap.
PATTERN = "(?U:" + "|".join([_EMAIL, _IP, _HEX, _IBAN, _CARD, _SSN, _PHONE, _NAME, _CALLED]) + ")"

_SYLLABLES = {
    "latin": ("b c d f g h k l m n p r s t v z br dr gr kl st tr".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф ш бр гр др ст тр вл".split(), "а е и о у".split()),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ χ βρ δρ κλ πρ στ τρ φλ γρ".split(), "α ε η ι ο".split()),
}
#: Scripts whose surrogates are letters of a range: first code point and number of letters.
RANGES = {
    "IsHan": (0x4E00, 20_000), "IsHiragana": (0x304B, 60), "IsKatakana": (0x30AB, 60), "IsHangul": (0xAC00, 11_172), "IsHebrew": (0x05D0, 26), "IsArabic": (0x0628, 18),
    "IsDevanagari": (0x0915, 37), "IsThai": (0x0E01, 46), "IsArmenian": (0x0561, 38), "IsGeorgian": (0x10D0, 33),
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: list[str]) -> str:
    return f"array({', '.join(map(_text, values))})"


def _case(key: str, of: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in of.items()) + f" ELSE {other} END"


def _with(expression: str, **bound: str) -> str:
    """An expression with names bound to values that are computed once, by nested one-element transforms."""
    for name, value in reversed(bound.items()):
        expression = f"element_at(transform(array({value}), {name} -> {expression}), 1)"
    return expression


def _luhn(digits: str, upto: str) -> str:
    """Sum of the digits at places 1 .. upto, those at an odd distance from the last place of all doubled."""
    d = f"cast(substring({digits}, i, 1) AS int)"
    return f"aggregate(sequence(1, {upto}), 0L, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 0 THEN {d} ELSE ({d} * 2) div 10 + ({d} * 2) % 10 END)"


#: Type of a mention; numbers that only look like a card's, as their check digit is wrong, are none.
_KIND = f"""CASE WHEN e LIKE '%@%' THEN 'email'
  WHEN e RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban'
  WHEN e RLIKE '^[0-9]+([.][0-9]+){{3}}$' THEN 'ip'
  WHEN e RLIKE '^[0-9A-Fa-f]+(:[0-9A-Fa-f]+){{5,7}}$' OR e LIKE '%::%' OR e RLIKE '^[0-9A-Fa-f]{{2}}(-[0-9A-Fa-f]{{2}}){{5}}$' THEN 'hex'
  WHEN e RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
  WHEN e RLIKE '^[2-6]([ -]?[0-9]){{12,18}}$' 
    THEN CASE WHEN {_with(_luhn("n", "length(n)") + " % 10 = 0", n="regexp_replace(e, '[^0-9]', '')")} THEN 'card' ELSE 'none' END
  WHEN e RLIKE '^[+(0-9]' THEN 'phone' ELSE 'name' END"""
#: Parts of a mention of a person: titles, then what follows, its given names, particles and surname, and an honorific.
_REST = f"regexp_replace(e, {_text('^(?:' + _TITLES + '[.]? )+')}, '')"
_LEAD = f"substring(e, 1, length(e) - length({_REST}))"
_GIVEN_NAMES = f"regexp_extract({_REST}, {_text(r'^((?:[\p{Lu}\p{Lo}][^ ]* )*)')}, 1)"
_PARTICLES = f"regexp_extract({_REST}, {_text(r'^(?:[\p{Lu}\p{Lo}][^ ]* )*((?:[^ ]+ )*)[^ ]+$')}, 1)"
_LAST = f"regexp_extract({_REST}, '([^ ]+)$', 1)"
_HONORIFIC = f"CASE WHEN {_LEAD} = '' THEN regexp_extract(e, {_text('(' + '|'.join(HONORIFICS) + ')$')}, 1) ELSE '' END"
_SURNAME = f"substring({_LAST}, 1, length({_LAST}) - length({_HONORIFIC}))"
_SCRIPT = "CASE WHEN s RLIKE '[\\\\u0400-\\\\u04FF]' THEN 'cyrillic' ELSE 'latin' END"
#: What is common to all mentions of an entity: case, separators, country code and gendered ending are not.
_CANON = _case(
    "kind",
    {
        "email": "lower(e)",
        "ip": "e",
        "hex": "lower(e)",
        "iban": "replace(e, ' ', '')",
        "card": "regexp_replace(e, '[^0-9]', '')",
        "ssn": "e",
        "phone": "right(regexp_replace(e, '[^0-9]', ''), 10)",
    },
    f"regexp_replace(lower({_SURNAME}), '(?<=[оеё]в|[иы]н)а$', '')",
)
#: A full name: its given name is an entity of its own, told apart from others with the same surname.
_FULL = f"kind = 'name' AND {_GIVEN_NAMES} <> ''"
_LETTER = r"[\p{L}\p{M}]"
_BYTE = "cast(conv(substring(h, 2 * pmod(i - 1, 64) + 1, 2), 16, 10) AS int)"


def _mapped(source: str, digit: str = f"{_BYTE} % 10") -> str:
    """Each digit and Latin letter of a string replaced by one of its class; the rest stays."""
    c = f"substring({source}, i, 1)"
    return f"""array_join(transform(sequence(1, length({source})), i -> CASE WHEN {c} RLIKE '[0-9]' THEN cast({digit} AS string)
      WHEN {c} RLIKE '[A-Z]' THEN chr(65 + {_BYTE} % 26) WHEN {c} RLIKE {_text(_LETTER)} THEN chr(97 + {_BYTE} % 26) ELSE {c} END), '')"""


def _mod97(source: str) -> str:
    c = f"substring({source}, i, 1)"
    return f"aggregate(sequence(1, length({source})), 0, (a, i) -> CASE WHEN {c} RLIKE '[0-9]' THEN (a * 10 + cast({c} AS int)) % 97 ELSE (a * 100 + ascii({c}) - 55) % 97 END)"


def _surname(script: str) -> str:
    onsets, vowels = _SYLLABLES[script]
    parts = [f"element_at({_listed(values)}, 1 + transform(array({n}), i -> {_BYTE} % {len(values)})[0])" for n in range(1, 6) for values in ([onsets, vowels, onsets, vowels, onsets][n - 1],)]
    return "concat(" + ", ".join([*parts, _more(script)]) + (", 'ов')" if script == "cyrillic" else ")")


def _more(script: str) -> str:
    """A vowel and an onset for each attempt after the first."""
    onsets, vowels = (f"element_at({_listed(values)}, 1 + {_BYTE} % {len(values)})" for values in _SYLLABLES[script])
    return f"array_join(transform(slice(sequence(6, 6 + 2 * attempt), 1, 2 * attempt), i -> CASE WHEN i % 2 = 0 THEN {vowels} ELSE {onsets} END), '')"


def _lettered(first: int, letters: int) -> str:
    """As many letters of a range as ``c`` has, and one more for each attempt after the first."""
    far = f"({_BYTE} * 256 + cast(conv(substring(h, 2 * pmod(i + 30, 64) + 1, 2), 16, 10) AS int)) % {letters}"
    return f"array_join(transform(sequence(1, length(c) + attempt), i -> decode(unhex(lpad(hex({first} + {far}), 4, '0')), 'UTF-16BE')), '')"


def _family(c: str) -> str:
    """A surname in the script of ``c``."""
    cases = [(r"[\u0400-\u04FF]", _surname("cyrillic")), (r"\p{IsGreek}", _surname("greek"))]
    cases += [(rf"\p{{{script}}}", _lettered(*span)) for script, span in RANGES.items()]
    return "CASE " + " ".join(f"WHEN {c} RLIKE {_text(pattern)} THEN {made}" for pattern, made in cases) + f" ELSE {_surname('latin')} END"


def _given_core() -> str:
    """Surrogate of ``c``, gender|script|given|surname: a name of the list, from the second attempt on with a second one that
    grows, and the surname, so that only given names of the same surname meet. Other scripts get generated names."""

    def pick(names: list[str], n: int) -> str:
        return f"element_at(transform(array({n}), i -> element_at({_listed(names)}, 1 + {_BYTE} % {len(names)})), 1)"

    lists = "CASE " + " ".join(
        f"WHEN g = {_text(g)} AND s = {_text(script)} THEN concat({pick(names, 1)}, CASE WHEN attempt > 0 THEN concat('-', {pick(names, 2)}, {_more(script).replace('attempt', '(attempt - 1)')}) ELSE '' END)"
        for (script, g), names in GIVEN.items()
    )
    other = _with(f"initcap({_family('c')})", c="name")
    whole = f"concat({lists} ELSE {other} END, ' ', surname)"
    return _with(whole, g="split_part(c, '|', 1)", s="split_part(c, '|', 2)", name="split_part(c, '|', 3)", surname="split_part(c, '|', 4)")


#: Surrogate of a canonical form ``c`` by digest ``h`` of the ``attempt``.
_EMAIL_CORE = f"""concat({_mapped("split_part(c, '@', 1)")}, array_join(transform(slice(sequence(33, 33 + attempt), 1, attempt), i -> chr(97 + {_BYTE} % 26)), ''), '@', {_mapped("split_part(split_part(c, '@', 2), '.', 1)", "pmod(" + _BYTE + " + i, 10)")},
  '.example.', CASE WHEN split_part(c, '.', -1) IN ('com', 'net', 'org') THEN split_part(c, '.', -1) ELSE 'com' END)"""
_HEXED = "array_join(transform(sequence(1, length(c)), i -> CASE WHEN substring(c, i, 1) RLIKE '[0-9a-f]' THEN substring('0123456789abcdef', 1 + " + _BYTE + " % 16, 1) ELSE substring(c, i, 1) END), '')"
_CARD_DRAFT = "concat(substring(c, 1, 1), substring(" + _mapped("c") + ", 2, length(c) - 2))"
_CARD_CORE = _with(f"""concat(d, cast((10 - ({_luhn("concat(d, '0')", "length(d)")}) % 10) % 10 AS string))""", d=_CARD_DRAFT)
_IBAN_CORE = _with(f"""concat(substring(c, 1, 2), lpad(cast(98 - {_mod97("concat(b, substring(c, 1, 2), '00')")} AS string), 2, '0'), b)""", b=f"substring({_mapped('c')}, 5)")
_CORE = _case(
    "kind",
    {
        "email": _EMAIL_CORE,
        "ip": "array_join(transform(sequence(1, 4), i -> cast(CASE WHEN i = 1 THEN 1 + " + _BYTE + " % 223 ELSE " + _BYTE + " END AS string)), '.')",
        "hex": _HEXED,
        "iban": _IBAN_CORE,
        "card": _CARD_CORE,
        "ssn": _mapped("c", f"CASE WHEN i = 1 THEN 1 + {_BYTE} % 5 WHEN i IN (3, 6, 11) THEN 1 + {_BYTE} % 9 ELSE {_BYTE} % 10 END"),
        "phone": _mapped("c", f"CASE WHEN length(c) - i IN (6, 9) THEN 2 + {_BYTE} % 8 ELSE {_BYTE} % 10 END"),
        "given": _given_core(),
    },
    _family("c"),
)
#: Numbers that found no free value so far have an extension after a mark.
_CORE = f"concat({_CORE}, CASE WHEN attempt >= {GROW} AND kind IN ('ip', 'hex', 'iban', 'card', 'ssn', 'phone') THEN concat('#', array_join(transform(sequence(34, 34 + attempt - {GROW}), i -> cast({_BYTE} % 10 AS string)), '')) ELSE '' END)"
_DIGITS_BEFORE = "length(regexp_replace(substring(e, 1, i), '[^0-9]', ''))"
_DIGITS = "length(regexp_replace(e, '[^0-9]', ''))"
_TITLE = "regexp_extract(e, '^([^ .]+)', 1)"
_GENDER = f"CASE WHEN array_contains({_listed(MALE_TITLES)}, {_TITLE}) THEN 'm' WHEN array_contains({_listed(FEMALE_TITLES)}, {_TITLE}) THEN 'f' ELSE 'n' END"


_OWN_SCRIPT = f"CASE WHEN g RLIKE '[A-Za-z\\\\u00C0-\\\\u024F]' THEN 'latin' WHEN g RLIKE '[\\\\u0400-\\\\u04FF]' THEN 'cyrillic' ELSE 'other' END"
_GIVEN = _with(f"concat_ws('|', {_GENDER}, {_OWN_SCRIPT}, g, c)", g=f"lower(trim({_GIVEN_NAMES}))")


#: A mention ``e`` with the digits or letters of its entity's surrogate ``core``.
_RENDERED = _case(
    "kind",
    {
        "email": "CASE WHEN e = upper(e) THEN upper(core) ELSE core END",
        "hex": "CASE WHEN e = upper(e) THEN upper(core) ELSE core END",
        "ip": "core",
        "ssn": "core",
        "none": "e",
        "iban": "array_join(transform(sequence(1, length(e)), i -> CASE WHEN substring(e, i, 1) = ' ' THEN ' ' ELSE substring(core, length(replace(substring(e, 1, i), ' ', '')), 1) END), '')",
        "card": f"array_join(transform(sequence(1, length(e)), i -> CASE WHEN substring(e, i, 1) RLIKE '[0-9]' THEN substring(core, {_DIGITS_BEFORE}, 1) ELSE substring(e, i, 1) END), '')",
        "phone": f"""array_join(transform(sequence(1, length(e)), i -> CASE WHEN substring(e, i, 1) RLIKE '[0-9]' AND {_DIGITS_BEFORE} > {_DIGITS} - length(core)
          THEN substring(core, {_DIGITS_BEFORE} - {_DIGITS} + length(core), 1) ELSE substring(e, i, 1) END), '')""",
    },
    _with(
        f"""concat({_LEAD}, CASE WHEN {_GIVEN_NAMES} = '' THEN '' WHEN {_GIVEN_NAMES} RLIKE '^[^ ][.] $' THEN concat(substring(given, 1, 1), '. ')
      WHEN {_GIVEN_NAMES} = upper({_GIVEN_NAMES}) THEN concat(upper(split_part(given, ' ', 1)), ' ') ELSE concat(split_part(given, ' ', 1), ' ') END, {_PARTICLES},
      CASE WHEN surname = upper(surname) AND surname <> lower(surname) THEN upper(core) ELSE initcap(core) END,
      CASE WHEN surname RLIKE 'а$' AND core RLIKE 'ов$' THEN 'а' WHEN surname RLIKE 'А$' AND core RLIKE 'ов$' THEN 'А' ELSE '' END, {_HONORIFIC})""",
        surname=_SURNAME,
    ),
)
_RENDERED = _with(f"concat({_RENDERED}, CASE WHEN extension <> '' THEN concat('-', extension) ELSE '' END)", extension="CASE WHEN kind IN ('name', 'email') THEN '' ELSE split_part(whole, '#', 2) END", core="split_part(whole, '#', 1)")


def _core(key: str, attempt: str) -> str:
    """A given name's digest leaves its surname out, so that it has one surrogate wherever that is free."""
    of = "CASE WHEN kind = 'given' THEN split_part(c, '|', 3) ELSE c END"
    return _with(_CORE, attempt=attempt, h=f"sha2(concat_ws('|', {_text(key)}, kind, {of}, cast(attempt AS string)), 512)")


def mentions(text: Column) -> Column:
    """The strings of the text that are replaced, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _entities(found: Column | str) -> Column:
    own = "struct(kind AS kind, c AS c)"
    both = f"CASE WHEN {_FULL} THEN array({own}, struct('given' AS kind, {_GIVEN} AS c)) ELSE array({own}) END"
    named = f"flatten(transform({found}, e -> " + _with(both, kind=_KIND, c=_CANON) + "))"
    return F.expr(f"filter({named}, n -> n.kind <> 'none')")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, c, attempt`` for the distinct entities that don't get their first surrogate.

    In each round an entity proposes its next surrogate. It is refused if an entity of the corpus is spelt like it, if
    it was given before, or if a smaller entity proposes the same; refused entities go on to the next round. So distinct
    entities keep distinct surrogates, and the same input gives the same ones. Every type's surrogates grow sooner or
    later, so the rounds end however many entities there are.
    """
    entities = materialize(entities.select("kind", "c").distinct(), "pii-entities")
    given, late, pending = None, None, entities
    for attempt in itertools.count():
        asked = materialize(pending.withColumn("core", F.expr(_core(key, str(attempt)))), "pii-asked")
        free = asked.join(entities.select("kind", F.col("c").alias("core")), ["kind", "core"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "core"), ["kind", "core"], "left_anti")
        won = materialize(free.groupBy("kind", "core").agg(F.min("c").alias("c")).withColumn("attempt", F.lit(attempt)), "pii-given")
        given = won if given is None else given.unionByName(won)
        if attempt:
            late = won if late is None else late.unionByName(won)
        pending = materialize(asked.join(won.select("kind", "c"), ["kind", "c"], "left_anti").select("kind", "c"), "pii-pending")
        if pending.isEmpty():
            return late.select("kind", "c", "attempt") if late is not None else entities.limit(0).withColumn("attempt", F.lit(0))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, personal data in its text replaced) and ``kinds``, the types replaced in order.

    E-mail addresses, IPv4, IPv6 and MAC addresses, IBANs, cards, social security and phone numbers, and names after a
    title or before an honorific get surrogates that a SHA-512 with ``key`` picks: of the same type, format, script,
    gender (of titled names), case and check digits. A card's number counts as one only if its check digit is right;
    an IBAN counts whatever its check digits. All mentions of an entity, whatever their case or separators, get the same
    surrogate, and distinct entities distinct ones (``surrogates``); a person's full name has its surname's surrogate and
    a given name that no other given name with that surname gets. A name that is titled somewhere in a text is replaced
    in that text where it stands without a title, too. An initial is replaced by an initial.

    Whole texts of any length are read. A text without personal data, or null, stays as it is; rows that repeat are
    treated alike; other columns, whatever their names, come back in ``row``. An empty table gives an empty result.

    Only entities that a collision moved need a join, on the digest of the texts that hold them; all others are
    rewritten in place, without a shuffle of texts.
    """
    found = nested(docs).withColumn("found", mentions(F.col("row.text")))
    held = found.where(F.size("found") > 0)
    entities = held.select(F.explode(_entities("found")).alias("n")).select("n.*")
    moved = surrogates(entities, key)
    if moved.isEmpty():
        return _rewritten(found.withColumn("moved", F.lit(None).cast("map<string,int>")), key)
    held = held.withColumn("digest", F.sha2("row.text", 256))
    named = held.select("digest", F.explode(F.array_distinct(_entities("found"))).alias("n")).select("digest", "n.*").distinct()
    entry = F.struct(F.concat("kind", F.lit("|"), "c"), "attempt")
    maps = named.join(moved, ["kind", "c"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(entry)).alias("moved"))
    sizes = held.groupBy("digest").agg(F.count("*").alias("n"))
    maps = materialize(maps.join(sizes, "digest"), "pii-moved")
    without = found.where(F.size("found") == 0).select("row", F.array().cast("array<string>").alias("kinds"))
    return _rewritten(with_lookup(held, maps, "digest", "n", outer=True).drop("n"), key).unionByName(without)


def _rewritten(rows: DataFrame, key: str) -> DataFrame:
    attempt = "coalesce(try_element_at(moved, concat(kind, '|', c)), 0)"
    given = f"CASE WHEN {_FULL} THEN {_with(_core(key, attempt), c=_GIVEN, kind=_text('given'))} END"
    one = _with(_RENDERED, kind=_KIND, c=_CANON, whole=_core(key, attempt), given=given)
    rows = rows.withColumns({"gaps": F.when(F.size("found") > 0, F.split("row.text", PATTERN, -1)), "new": F.when(F.size("found") > 0, F.expr(f"transform(found, e -> {one})"))})
    rows = rows.withColumn("names", F.expr(_NAMES))
    rows = rows.withColumn("pattern", F.expr(_ANY_NAME))
    gaps = F.expr(f"CASE WHEN size(names) > 0 THEN transform(gaps, g -> {_UNTITLED}) ELSE gaps END")
    text = F.expr("concat(array_join(zip_with(slice(gaps, 1, size(found)), new, (g, r) -> concat(g, r)), ''), element_at(gaps, -1))")
    kinds = F.expr(f"filter(transform(found, e -> {_KIND}), kind -> kind <> 'none')").alias("kinds")
    text = F.when(F.size("found") > 0, text).otherwise(F.col("row.text"))
    return rows.withColumn("gaps", gaps).select(F.col("row").withField("text", text).alias("row"), kinds)


#: Full names and surnames of a text's titled mentions, and what they became.
_NAME_PAIRS = f"""CASE WHEN {_LEAD} <> '' AND ({_KIND}) = 'name' THEN
  array(struct({_REST} AS old, substring(r, 1 + length({_LEAD})) AS new), struct({_SURNAME} AS old, regexp_extract(r, '([^ ]+)$', 1) AS new))
  ELSE array() END"""
_NAMES = f"array_distinct(flatten(transform(arrays_zip(found, new), z -> {_with(_NAME_PAIRS, e='z.found', r='z.new')})))"
_ANY_NAME = "CASE WHEN size(names) > 0 THEN concat('(?<![\\\\p{L}\\\\p{N}])(?:', array_join(transform(names, n -> concat('\\\\Q', n.old, '\\\\E')), '|'), ')(?![\\\\p{L}\\\\p{N}])') END"
#: A gap between mentions with the names that stand in it without a title replaced.
_UNTITLED = _with(
    "concat(array_join(zip_with(slice(between, 1, size(old)), transform(old, o -> element_at(filter(names, n -> n.old = o), 1).new), (b, n) -> concat(b, n)), ''), element_at(between, -1))",
    old="regexp_extract_all(g, pattern, 0)",
    between="split(g, pattern, -1)",
)

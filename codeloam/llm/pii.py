"""Format-preserving pseudonyms for personal data, in built-in functions alone.

Validated values are found by one pattern and replaced by a keyed permutation of their own format: a
balanced Feistel network over their characters, whose round function is SHA-256 of key, round and the
other half. Digits stay digits, letters stay letters of the same case, separators stay where they are;
card and account numbers are those with right check digits and keep such, addresses keep octets up to 255, dates are
days of the calendar and stay such, in their order. Letters beyond a to z, Latin-1 and Cyrillic stay as they are.
Equal values get equal pseudonyms in every document, whatever their separators or case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Feistel rounds; an even number, so both halves return to their places.
ROUNDS = 10

#: Phones: with a bracketed area code; 3-3-4 digits, with or without a country code; a plus and 8 to 15 digits,
#: parted or not; a trunk zero, area code and number; a trunk zero and pairs.
_PHONES = (
    r"\+?[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"(?<![0-9][.-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?!-[0-9])",
    r"\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}",
    r"(?<![0-9][.-])0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}(?![.-][0-9])",
    r"(?<![0-9][.-])0[1-9](?:[ .-][0-9]{2}){4}(?![.-][0-9])",
)
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^[+](?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: The patterns of each kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}][\p{L}\p{N}-]{0,62}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "key": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,72}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z+])(?:{'|'.join(_PHONES)})(?![0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9A-Za-z/-])",
    "address": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "identity": r"(?<![0-9A-Za-z-])(?!000|666)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{3}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: What leads a key and stays, and the letters that are permuted among themselves, besides a to z.
_LEADS = "^(AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk-)"
_LETTERS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя")

#: Days from 1900-01-01 to 2099-12-31, and the two moduli whose product just covers them.
_DAYS, _A, _B = 73049, 271, 270


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _random(key: str, round_: str, half: str, at: str) -> str:
    """Sixteen bits for a place: four digits of a keyed SHA-256, a new one for every sixteen places."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, {round_}, {half}, cast(({at}) div 16 as string)), 256), 4 * pmod({at}, 16) + 1, 4), 16, 10) as int)"


def _feistel(value: str, key: str, letters: str | None = None, more: tuple[str, ...] = ()) -> str:
    """value, a string of digits and lower-case letters, permuted: each place within its own alphabet, or all within
    that of `letters`; `more` are further alphabets."""
    c = "substr(s.a, i, 1)"
    shift = lambda alphabet: f"substr('{alphabet}', cast(pmod(instr('{alphabet}', {c}) - 1 + {_random(key, 'r', 's.b', 'i - 1')}, {len(alphabet)}) + 1 as int), 1)"
    if letters:
        moved = shift(letters)
    else:
        moved = f"case when {c} between '0' and '9' then {shift('0123456789')} when {c} between 'a' and 'z' then {shift('abcdefghijklmnopqrstuvwxyz')} {' '.join(f"when instr('{x}', {c}) > 0 then {shift(x)}" for x in more)} else {c} end"
    mixed = f"if(length(s.a) = 0, '', array_join(transform(sequence(1, length(s.a)), i -> {moved}), ''))"
    halves = f"named_struct('a', substr({value}, 1, length({value}) div 2), 'b', substr({value}, length({value}) div 2 + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {halves}, (s, r) -> named_struct('a', s.b, 'b', {mixed}), s -> concat(s.a, s.b))"


def _put_back(value: str, core: str, kept: str) -> str:
    """value with the characters of class `kept` replaced by those of core in turn, in the case they had."""
    ch = f"substr({value}, p, 1)"
    new = "substr(q.core, q.k, 1)"
    step = f"if({ch} rlike '{kept}', named_struct('core', q.core, 'out', concat(q.out, if({ch} != lower({ch}), upper({new}), {new})), 'k', q.k + 1), named_struct('core', q.core, 'out', concat(q.out, {ch}), 'k', q.k))"
    return f"aggregate(sequence(1, length({value})), named_struct('core', {core}, 'out', '', 'k', 1), (q, p) -> {step}, q -> q.out)"


def _luhn(digits: str) -> str:
    """Sum of the Luhn scheme for digits that a check digit will follow."""
    d = f"cast(substr({digits}, length({digits}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, j) -> t + if(j % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"


def _valid(v: str) -> str:
    """Whether the Luhn sum of all digits of v, check digit included, holds."""
    return f"transform(array(regexp_replace({v}, '[^0-9]', '')), d -> pmod({_luhn('substr(d, 1, length(d) - 1)')} + cast(substr(d, -1) as int), 10) = 0)[0]"


def _head(v: str) -> str:
    """The first four groups of a card number that three more digits follow."""
    return f"substr({v}, 1, 19)"


def _cards(key: str) -> str:
    """If just the first four groups are a valid number, the digits after them aren't part of it and stay."""
    return f"transform(array(if({_valid('v')}, v, {_head('v')})), w -> concat({_card(key, 'w')}, substr(v, length(w) + 1)))[0]"


def _card(key: str, v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    inner = f"transform(array({digits}), d -> transform(array(named_struct('p', {_feistel('substr(d, 1, length(d) - 1)', key)}, 'old', pmod(10 - pmod({_luhn('substr(d, 1, length(d) - 1)')}, 10), 10), 'last', cast(substr(d, -1) as int))), e -> concat(e.p, cast(pmod(pmod(10 - pmod({_luhn('e.p')}, 10), 10) + e.last - e.old, 10) as string)))[0])[0]"
    return f"transform(array({inner}), core -> {_put_back(v, 'core', '[0-9]')})[0]"


def _plain(key: str, kept: str) -> str:
    return f"transform(array({_feistel(f"lower(regexp_replace(v, '[^{kept[1:-1]}]', ''))", key)}), core -> {_put_back('v', 'core', kept)})[0]"


def _phone(key: str) -> str:
    """The country code stays: what stands before a bracket, else what a plus leads, else what precedes ten digits."""
    ahead = (
        "case when instr(v, '(') > 0 then substr(v, 1, instr(v, '(') - 1) "
        f"when v like '+%' then regexp_extract(v, {_sql(_COUNTRY)}, 0) when v like '0%' then '' "
        "else regexp_extract(v, '^(.*?)[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}$', 1) end"
    )
    rest = "substr(v, length(h) + 1)"
    return f"transform(array({ahead}), h -> transform(array({_feistel(f"regexp_replace({rest}, '[^0-9]', '')", key)}), core -> concat(h, {_put_back(rest, 'core', '[0-9]')}))[0])[0]"


def _email(key: str) -> str:
    """The domain stays."""
    local, kept = "substring_index(v, '@', 1)", "0-9A-Za-zÀ-ÖØ-öø-þА-я"
    return f"transform(array({_feistel(f"lower(regexp_replace({local}, '[^{kept}]', ''))", key, more=_LETTERS)}), core -> concat({_put_back(local, 'core', f'[{kept}]')}, substr(v, instr(v, '@'))))[0]"


def _key(key: str) -> str:
    """What tells a key's kind stays."""
    rest = "substr(v, length(h) + 1)"
    return f"transform(array(regexp_extract(v, '{_LEADS}', 1)), h -> transform(array({_feistel(f"lower(regexp_replace({rest}, '[^0-9A-Za-z]', ''))", key)}), core -> concat(h, {_put_back(rest, 'core', '[0-9A-Za-z]')}))[0])[0]"


def _mod97(v: str) -> str:
    """The remainder of an account number whose first four characters were put last, letters as 10 to 35."""
    c = "substr(x, i, 1)"
    step = f"if({c} between '0' and '9', (t * 10 + cast({c} as int)) % 97, (t * 100 + ascii({c}) - 55) % 97)"
    return f"transform(array({v}), x -> aggregate(sequence(1, length(x)), 0, (t, i) -> {step}))[0]"


def _account(v: str) -> str:
    return f"transform(array(replace({v}, ' ', '')), d -> {_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1 and length(d) between 15 and 34)[0]"


def _iban(key: str) -> str:
    """The country stays, and the check digits are made anew."""
    rest = "substr(v, 5)"
    inner = f"transform(array({_feistel(f"lower(replace({rest}, ' ', ''))", key)}), core -> {_put_back(rest, 'core', '[0-9A-Za-z]')})[0]"
    check = _mod97("concat(replace(y, ' ', ''), substr(v, 1, 2), '00')")
    return f"transform(array({inner}), y -> concat(substr(v, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), y))[0]"


def _ipv6(key: str) -> str:
    core = f"transform(array({_feistel("lower(replace(v, ':', ''))", key, '0123456789abcdef')}), core -> lower({_put_back('v', 'core', '[0-9A-Fa-f]')}))[0]"
    return f"if(v rlike '[A-F]', upper({core}), {core})"


def _two(x: str, a: int, b: int, key: str) -> str:
    """A permutation of 0 .. a * b - 1: a Feistel network over quotient and remainder."""
    rnd = lambda half: f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, r, {half}), 256), 1, 8), 16, 10) as bigint)"
    step = f"transform(array(pmod(s.l + {rnd('s.r')}, {a})), l -> named_struct('l', l, 'r', pmod(s.r + {rnd('l')}, {b})))[0]"
    return f"aggregate(sequence(1, {ROUNDS // 2}), named_struct('l', cast({x} as bigint) div {b}, 'r', pmod(cast({x} as bigint), {b})), (s, r) -> {step}, s -> s.l * {b} + s.r)"


def _address(key: str) -> str:
    number = "aggregate(split(v, '[.]'), 0L, (t, o) -> t * 256 + cast(o as bigint))"
    return f"transform(array({_two(number, 65536, 65536, key)}), x -> concat_ws('.', cast(x div 16777216 as string), cast(x div 65536 % 256 as string), cast(x div 256 % 256 as string), cast(x % 256 as string)))[0]"


#: Orders of a date's parts as patterns, and the same parts as year-month-day. The first that gives a day of the
#: calendar holds: day first before month first.
_ORDERS = {
    "yyyy-MM-dd": "v",
    "dd/MM/yyyy": "concat_ws('-', substr(v, 7, 4), substr(v, 4, 2), substr(v, 1, 2))",
    "MM/dd/yyyy": "if(substr(v, 3, 1) = '/', concat_ws('-', substr(v, 7, 4), substr(v, 1, 2), substr(v, 4, 2)), null)",
}


def _day(iso: str) -> str:
    """A day's number from 1900-01-01, null if it isn't in the calendar."""
    return f"datediff(try_to_timestamp({iso}, 'yyyy-MM-dd'), date'1900-01-01')"


def _real_date(v: str) -> str:
    return f"transform(array({v}), v -> coalesce({', '.join(_day(iso) for iso in _ORDERS.values())}) is not null)[0]"


def _date(key: str) -> str:
    """Day numbers are walked along the cycle until one lies in range again, and written in the order they were in."""
    walk = f"aggregate(sequence(1, 24), named_struct('x', cast(n as bigint), 'on', true), (w, _i) -> if(w.on, transform(array({_two('w.x', _A, _B, key)}), y -> named_struct('x', y, 'on', y >= {_DAYS}))[0], w), w -> w.x)"
    moved = f"transform(array({{n}}), n -> date_add(date'1900-01-01', cast({walk} as int)))[0]"
    cases = [f"when {_day(iso)} is not null then replace(date_format({moved.format(n=_day(iso))}, '{order}'), '/', {"'/'" if order == 'yyyy-MM-dd' else 'substr(v, 3, 1)'})" for order, iso in _ORDERS.items()]
    return f"case {' '.join(cases)} end"


def _hex(key: str) -> str:
    return f"transform(array({_feistel('lower(v)', key, '0123456789abcdef')}), core -> if(v rlike '[A-F]', upper(core), core))[0]"


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of a lambda variable v, by its kind k."""
    return (
        "case k "
        f"when 'email' then {_email(key)} when 'secret' then {_hex(key)} when 'phone' then {_phone(key)} "
        f"when 'key' then {_key(key)} when 'iban' then {_iban(key)} when 'ipv6' then {_ipv6(key)} "
        f"when 'date' then {_date(key)} when 'address' then {_address(key)} when 'identity' then {_plain(key, '[0-9]')} "
        f"when 'card' then {_cards(key)} else v end"
    )


def _kind(v: str) -> str:
    """The kind of a value that ANY has found; the first pattern in order that takes all of it. A number without right
    check digits is no card or account, and what isn't in the calendar is no date: their kind is null."""
    right = {"card": f"{_valid(v)} or (length({v}) = 23 and {_valid(_head(v))})", "iban": _account(v), "date": _real_date(v)}
    return "case " + " ".join(f"when {v} rlike {_sql(f'^(?:{p})$')} then " + (f"case when {right[k]} then '{k}' end" if k in right else f"'{k}'") for k, p in PATTERNS.items()) + " end"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", pii: str = "pii") -> DataFrame:
    """docs with every personal value in `text` replaced, and a column `pii`: an array of (kind, value,
    pseudonym) in order of occurrence (empty where there is none).

    Null texts stay null with an empty array; all other columns and all rows are kept; a column of
    that name is replaced. Whole texts are searched."""
    found = docs.withColumn(pii, F.when(F.col(text).rlike(r"[0-9]{2}|@|[0-9]\.|::|sk-|xox|gh[pousr]_|AIza|A[KS]IA|:[0-9]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))
    kinds = f"transform({pii}, v -> named_struct('kind', {_kind('v')}, 'value', v))"
    found = found.withColumn(pii, F.expr(f"if({pii} is null or size({pii}) = 0, cast(array() as array<struct<kind:string,value:string>>), {kinds})"))
    masks = f"transform({pii}, z -> named_struct('kind', z.kind, 'value', z.value, 'pseudonym', transform(array(z.kind), k -> transform(array(z.value), v -> {pseudonym(key)})[0])[0]))"
    found = found.withColumn(pii, F.expr(masks))
    # values of no kind stay as they are, and leave the report once the text is joined
    parts = unused(docs, "__parts")
    whole = found.withColumn(parts, F.when(F.size(pii) > 0, F.split(F.col(text), ANY, -1)))
    joined = F.expr(f"concat({parts}[0], array_join(transform({pii}, (z, i) -> concat(z.pseudonym, {parts}[i + 1])), ''))")
    return whole.withColumn(text, F.when(F.size(pii) > 0, joined).otherwise(F.col(text))).drop(parts).withColumn(pii, F.expr(f"filter({pii}, z -> z.kind is not null)"))


def pseudonym_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (pseudonymised), text_sha256, and how many values of each kind were replaced."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    counts = [F.expr(f"cast(size(filter(pii, z -> z.kind = '{k}')) as long) as n_{k}") for k in PATTERNS]
    return out.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"), *counts)

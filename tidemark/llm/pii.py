"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame expressions only.

A value is found by one pattern, validated (Luhn, mod-97, calendar, octets, numbering plan), mapped to two numbers
L < a and R < b, and permuted by rounds that add SHA-256 values keyed by secret, kind and round to either half, modulo
its size. That is a bijection of the kind's format, so equal values stay equal across documents and different ones
stay different. Words (mailbox names, keys) are permuted in the same way, letter by letter within their classes.

Dates are permuted within their class (field order, and which of day and month have one digit), by walking the
permutation of year, month and day numbers until it meets a day of the calendar; a walk visits no value of another class.

Of an e-mail address the mailbox is replaced and the domain stays, as it names a provider and not a person; who takes a
domain of one's own for personal must treat it as a kind of its own.

The secret key comes in as the column of a one-row table, so neither plans nor the event log hold it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY = "__pii_key"  # the column that holds the secret
TEST_KEY = "key of local test runs"
CONF = "spark.tidemark.pii.key"
WALK = 24
ROUNDS = 8
#: kind: pattern. The first alternative that matches wins. A repeated group costs the matcher stack per turn, so every one has a
#: bound: 127 labels in a domain, eight blocks in an account number; single characters are repeated without.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,24}(?![\w@])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)(?-i:)\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,128}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w.,/-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w]|[-/.]\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
    "phone": r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)",
}


def key_of(spark: SparkSession) -> str:
    """The secret in ``spark.tidemark.pii.key``; where it is unset, a fixed one on a local master, else an error."""
    key = spark.conf.get(CONF, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CONF} is not set")
    return key or TEST_KEY


def _q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(kinds: list[str]) -> str:
    """One pattern of all kinds; groups by number move with their place."""
    parts, groups = [], 0
    for k in kinds:
        p = PATTERNS[k]
        for g in (2, 1):
            p = p.replace(f"\\{g}", f"\\{g + groups}")
        groups += 2 * (k == "date")
        parts.append(f"(?:{p})")
    return "|".join(parts)


def _round_value(key: str, kind: str, round_: str, half: str) -> str:
    return f"cast(conv(substr(sha2(concat({key}, '|{kind}|', {round_}, '|', {half}), 256), 1, 15), 16, 10) as bigint)"


def feistel(left: str, a: str, right: str, b: str, key: str, kind: str) -> str:
    """SQL: struct(l, r) of the permuted halves; ``left`` < ``a`` and ``right`` < ``b`` are BIGINT expressions."""
    even = f"named_struct('l', pmod(s.l + pmod({_round_value(key, kind, 'i', 's.r')}, s.a), s.a), 'r', s.r, 'a', s.a, 'b', s.b)"
    odd = f"named_struct('l', s.l, 'r', pmod(s.r + pmod({_round_value(key, kind, 'i', 's.l')}, s.b), s.b), 'a', s.a, 'b', s.b)"
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint), 'a', cast({a} as bigint), 'b', cast({b} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digits(s: str, key: str, kind: str) -> str:
    """SQL: a digit string of 2 to 36 digits permuted within its length."""
    f = feistel("substr(d, 1, length(d) div 2)", "cast(rpad('1', length(d) div 2 + 1, '0') as bigint)", "substr(d, length(d) div 2 + 1)", "cast(rpad('1', length(d) - length(d) div 2 + 1, '0') as bigint)", key, kind)
    return let(s, "d", let(f, "f", "concat(lpad(cast(f.l as string), length(d) div 2, '0'), lpad(cast(f.r as string), length(d) - length(d) div 2, '0'))"))


def word(s: str, key: str, kind: str) -> str:
    """SQL: a word permuted character by character within digits, lower and upper case letters (or hexadecimal
    digits, if it has no others), in two halves; other characters stay. Case doesn't change which word it is. Of a word of one
    character the first half is empty and stays so (it splits into one empty string, which is a class of its own)."""
    classes = "case when hexa and c rlike '[0-9a-f]' then '0123456789abcdef' when c rlike '[0-9]' then '0123456789' when c rlike '[a-z]' then 'abcdefghijklmnopqrstuvwxyz' when c rlike '[A-Z]' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else c end"
    stream = f"conv(substr(sha2(concat({key}, '|{kind}|', i, '|', k div 16, '|', lower({{half}})), 256), (k % 16) * 4 + 1, 4), 16, 10)"
    turn = lambda own, half: f"array_join(transform(split({own}, ''), (c, k) -> transform(array({classes}), al -> substr(al, 1 + cast(pmod(locate(c, al) - 1 + cast({stream.format(half=half)} as int), greatest(length(al), 1)) as int), 1))[0]), '')"
    step = f"if(i % 2 = 0, named_struct('l', {turn('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {turn('s.r', 's.l')}))"
    f = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr(w, 1, length(w) div 2), 'r', substr(w, length(w) div 2 + 1)), (s, i) -> {step}, s -> concat(s.l, s.r))"
    return let(s, "w", let("w rlike '^[0-9a-f]+$' and length(w) >= 8", "hexa", f))


def refill(m: str, p: str, what: str = "[0-9]") -> str:
    """SQL: ``m`` with its characters of class ``what`` replaced by those of ``p``, in order."""
    return f"aggregate(split({m}, ''), named_struct('s', '', 'k', 1), (a, c) -> if(c rlike '^{what}$', named_struct('s', concat(a.s, substr({p}, a.k, 1)), 'k', a.k + 1), named_struct('s', concat(a.s, c), 'k', a.k)), a -> a.s)"


def luhn_sum(d: str) -> str:
    """SQL: the Luhn sum of a digit string, its last digit taken as the check digit."""
    return f"aggregate(transform(split(reverse({d}), ''), (c, k) -> if(k % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0))), 0, (x, y) -> x + y)"


def mod97(s: str) -> str:
    """SQL: an alphanumeric string read as a number, letters as 10 to 35, modulo 97."""
    return f"aggregate(split({s}, ''), 0, (x, c) -> if(c rlike '[0-9]', (x * 10 + cast(c as int)) % 97, (x * 100 + ascii(c) - 55) % 97))"


def _kinds(key: str) -> dict[str, tuple[str, str]]:
    """kind: (whether a match m is valid, its pseudonym), in SQL."""
    only = "regexp_replace(m, '[^0-9]', '')"
    out = {}
    at = "locate('@', m)"
    out["email"] = ("true", f"concat({word(f'substr(m, 1, {at} - 1)', key, 'email')}, substr(m, {at}))")
    value = r"regexp_extract(m, '[A-Za-z0-9+/_-]+$', 0)"
    aws = f"concat('AKIA', {word('substr(m, 5)', key, 'secret')})"
    out["secret"] = ("m rlike '^AKIA' or regexp_extract(m, '[A-Za-z0-9+/_-]+$', 0) rlike '[0-9]'", f"if(m rlike '^AKIA[A-Z0-9]{{16}}$', {aws}, {let(value, 'v', 'concat(substr(m, 1, length(m) - length(v)), ' + word('v', key, 'secret') + ')')})")
    flat = "replace(m, ' ', '')"
    bban = word("substr(n, 5)", key, "iban")
    check = f"concat(substr(n, 1, 2), lpad(cast(98 - {mod97('concat(q, substr(n, 1, 2), ' + chr(39) + '00' + chr(39) + ')')} as string), 2, '0'), q)"
    out["iban"] = (f"length({flat}) between 15 and 34 and {let(flat, 'n', mod97('concat(substr(n, 5), substr(n, 1, 4))'))} = 1", let(flat, "n", let(bban, "q", let(check, "z", refill("m", "z", "[A-Z0-9]")))))
    o = lambda i: f"cast(split(m, '[.]')[{i}] as bigint)"
    out["ip"] = (f"{o(0)} between 1 and 255 and {o(1)} < 256 and {o(2)} < 256 and {o(3)} < 256", let(feistel(f"{o(0)} * 256 + {o(1)} - 256", "65280", f"{o(2)} * 256 + {o(3)}", "65536", key, "ip"), "f", "concat_ws('.', (f.l + 256) div 256, (f.l + 256) % 256, f.r div 256, f.r % 256)"))
    area = "(cast(substr(m, 1, 3) as bigint) - 1 - if(cast(substr(m, 1, 3) as bigint) > 666, 1, 0))"
    out["ssn"] = ("substr(m, 1, 3) not in ('000', '666') and m < '9' and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'", let(feistel(f"{area} * 99 + cast(substr(m, 5, 2) as bigint) - 1", "88902", "cast(substr(m, 8) as bigint) - 1", "9999", key, "ssn"), "f", "concat(lpad(cast(f.l div 99 + 1 + if(f.l div 99 + 1 > 665, 1, 0) as string), 3, '0'), '-', lpad(cast(f.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(f.r + 1 as string), 4, '0'))"))
    # a day from 1900-01-01 to 2099-12-31. Its class: order of fields (year, day or month first; what can be read day first
    # is), and whether month and day have one digit. Numbers of a class: year * months + month, and day, from their least
    f = lambda i: f"split(m, '[-/.]')[{i}]"
    as_date = lambda a, b, c: f"try_to_timestamp(concat({a}, '-', lpad({b}, 2, '0'), '-', lpad({c}, 2, '0')), 'yyyy-MM-dd')"
    order = f"case when length({f(0)}) = 4 then 'y' when {as_date(f(2), f(1), f(0))} is not null then 'd' else 'm' end"
    field = lambda y, d, m: f"case o when 'y' then {y} when 'd' then {d} else {m} end"
    year, month, day = field(f(0), f(2), f(2)), field(f(1), f(1), f(0)), field(f(2), f(0), f(1))
    read = let(order, "o", f"named_struct('o', o, 'y', {year}, 'm', {month}, 'd', {day})")
    as_parts = let(read, "p", "named_struct('o', p.o, 'y', cast(p.y as bigint) - 1900, 'm', cast(p.m as bigint) - 1, 'd', cast(p.d as bigint), 'wm', length(p.m), 'wd', length(p.d), 'months', if(length(p.m) = 1, 9, 12), 'd0', if(p.o = 'm', 13, 1), 'days', case when p.o = 'm' then 19 when length(p.d) = 1 then 9 else 31 end)")
    turned = lambda left, right: feistel(left, "200 * c.months", right, "c.days", key, "date")
    good = "s.r + c.d0 <= day(last_day(make_date(cast(1900 + s.l div c.months as int), cast(s.l % c.months + 1 as int), 1)))"
    walked = f"aggregate(sequence(1, {WALK}), {turned('c.y * c.months + c.m', 'c.d - c.d0')}, (s, w) -> if({good}, s, {turned('s.l', 's.r')}))"
    yyyy = "cast(1900 + f.l div c.months as string)"
    mm, dd = "lpad(cast(f.l % c.months + 1 as string), c.wm, '0')", "lpad(cast(f.r + c.d0 as string), c.wd, '0')"
    joined = lambda *x: "concat(" + ", sep, ".join(x) + ")"
    shown = let("regexp_extract(m, '[-/.]', 0)", "sep", f"case c.o when 'y' then {joined(yyyy, mm, dd)} when 'd' then {joined(dd, mm, yyyy)} else {joined(mm, dd, yyyy)} end")
    known = f"coalesce({as_date(f(0), f(1), f(2))}, {as_date(f(2), f(1), f(0))}, {as_date(f(2), f(0), f(1))})"
    out["date"] = (f"coalesce(year({known}), 0) between 1900 and 2099", let(as_parts, "c", let(walked, "f", shown)))
    body = digits("substr(d0, 2, length(d0) - 2)", key, "card")
    full = let(f"concat(substr(d0, 1, 1), {body})", "b", f"concat(b, cast((10 - {luhn_sum(chr(99) + 'oncat(b, ' + chr(39) + '0' + chr(39) + ')')} % 10) % 10 as string))")
    out["card"] = (f"substr({only}, 1, 1) <> '0' and {let(only, 'd0', luhn_sum('d0'))} % 10 = 0", let(only, "d0", let(full, "p", refill("m", "p"))))
    ten = "right(regexp_replace(m, '[^0-9]', ''), 10)"
    n = lambda a, k: f"cast(substr(d0, {a}, {k}) as bigint)"
    phone = let(feistel(f"({n(1, 3)} - 200) * 800 + {n(4, 3)} - 200", "640000", n(7, 4), "10000", key, "phone"), "f", "concat(if(length(regexp_replace(m, '[^0-9]', '')) = 11, '1', ''), cast(f.l div 800 + 200 as string), cast(f.l % 800 + 200 as string), lpad(cast(f.r as string), 4, '0'))")
    out["phone"] = (f"{let(ten, 'd0', n(1, 3) + ' >= 200 and ' + n(4, 3) + ' >= 200')}", let(ten, "d0", let(phone, "p", refill("m", "p"))))
    return out


def _pseudonyms(key: str, kinds: list[str]) -> Column:
    """array<struct<kind, value, pseudonym>> of the matches in column __found; kind is null where one isn't valid."""
    rules = _kinds(key)
    which = "case " + " ".join(f"when m rlike {_q('^(?:' + PATTERNS[k] + ')$')} and ({rules[k][0]}) then '{k}'" for k in kinds) + " end"
    made = "case kind " + " ".join(f"when '{k}' then {rules[k][1]}" for k in kinds) + " else m end"
    return F.expr(f"transform(__found, m -> transform(array({which}), kind -> named_struct('kind', kind, 'value', m, 'pseudonym', {made}))[0])")


def pseudonymise(docs: DataFrame, key: str | None = None, kinds: list[str] | None = None, column: str = "text") -> DataFrame:
    """``docs`` with every validated value in ``column`` replaced; plus n_private (long) and private_kinds (array).

    Null text stays null with no values; empty and clean texts come back as they are; repeated rows and ids keep a row
    each; an empty table gives no rows. All other columns stay, but for columns named n_private or private_kinds, which
    the results replace. ``key``: the secret, by default that of ``key_of``.
    """
    kinds, docs = kinds or list(PATTERNS), docs.drop("n_private", "private_kinds")
    spark = docs.sparkSession
    secret = spark.createDataFrame(pa.table({KEY: [key or key_of(spark)]}))
    found = F.regexp_extract_all(F.col(column), F.lit(_any(kinds)), 0)
    may = F.col(column).rlike(r"[0-9@]|[=:]")  # every pattern needs one of these
    # secret is one row: every row of docs gets its column
    d = docs.join(F.broadcast(secret)).withColumn("__found", F.when(may, found).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("__made", F.when(F.size("__found") > 0, _pseudonyms(KEY, kinds)))
    pieces = F.split(F.col(column), _any(kinds), -1)
    whole = F.array_join(F.zip_with(pieces, F.col("__made"), lambda p, m: F.concat(p, F.coalesce(m["pseudonym"], F.lit("")))), "")
    valid = F.filter(F.transform("__made", lambda m: m["kind"]), lambda k: k.isNotNull())
    hit = F.coalesce(F.size(valid), F.lit(0)) > 0
    d = d.withColumn("__text", F.when(hit, whole).otherwise(F.col(column)))
    kinds_of = F.when(hit, valid).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({"n_private": F.size(kinds_of).cast("long"), "private_kinds": kinds_of})
    return d.select(*[F.col("__text").alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns], "n_private", "private_kinds")

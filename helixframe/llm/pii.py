"""Personal data in text: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a Spark SQL expression. A pattern's matches and the text between them (the same
pattern's split) alternate, so a running sum of their lengths gives each match's place. Places
count code points, and an end is exclusive.

Base kinds (email, ip, card, phone) stay whatever their score is. Further kinds (iban, ssn, local
phone, secret) stay where their score reaches LEAST_SCORE and they overlap no base span. Scores are
in hundredths: a kind's prior, plus what a confirmed checksum and context words add or take.

Defined results: null text counts as empty and has no spans; texts of any length are searched whole (places of
spans are folded up, so that time grows with the square of the spans of one text); equal rows each get a row; an empty
table gives an empty result. Columns that are not asked for with `carry` don't matter; redact() gives all
columns of docs back, of whatever name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_SCORE = 60
#: Code points before and after a span that are searched for context words.
BEFORE, AFTER = 40, 20


@dataclass(frozen=True)
class Kind:
    """pattern: for Java, of time linear in the text. plain: the same language for an engine without look-around.

    guard: a condition on _t that every text with a match fulfils. keep: a condition on the match
    x.m that confirms it. after: characters that no span follows.
    """

    name: str
    pattern: str
    prior: int
    plain: str = ""
    guard: str = "true"
    keep: str = "true"
    context: str = ""
    gain: int = 0
    after: str = ""


_LOCAL = r"[A-Za-z0-9._%+-]"
_DIGITS = "regexp_replace(x.m, '[ -]', '')"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Every second digit from the right, doubled, less nine if above nine.
_LUHN = (
    f"aggregate(sequence(1, char_length({_DIGITS})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr(reverse({_DIGITS}), i, 1)) "
    f"ELSE int(translate(substr(reverse({_DIGITS}), i, 1), '0123456789', '0246813579')) END) % 10 = 0"
)
_IBAN = "regexp_replace(x.m, '[^A-Z0-9]', '')"
_MOD97 = (
    f"aggregate(transform(sequence(1, char_length({_IBAN})), i -> substr(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), i, 1)), 0, "
    "(a, c) -> CASE WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + int(c)) % 97 END) = 1"
)

BASE = (
    # A local part has no @, so that only its first character, or the end of the match before, can begin a match.
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90, rf"{_LOCAL}+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", guard="contains(_t, '@')"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", 60, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", keep=rf"x.m RLIKE r'^{_BYTE}(?:\.{_BYTE}){{3}}$'", context="version|release|build|section", gain=-30),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 90, r"[0-9]([\x20-]?[0-9])+", keep=f"char_length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", context="card|visa|credit|karte|carte|tarjeta", gain=10),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 70, r"\+[0-9][\x20().0-9-]+[0-9]", guard="contains(_t, '+')", keep="char_length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15", context="phone|tel|call|mobile|fax", gain=20),
)
EXTRA = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 80, keep=_MOD97, context="iban|bank|konto|compte|cuenta", gain=10, after="A-Za-z0-9"),
    Kind("ssn", r"[0-9]+-[0-9]+-[0-9-]*[0-9]", 30, keep="x.m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", context="ssn|social security|taxpayer", gain=50, after="0-9-"),
    Kind("local", r"\([0-9]{3}\) [0-9]{3}-[0-9]+", 40, guard="contains(_t, ') ')", keep="char_length(x.m) = 14", context="phone|tel|call|mobile|fax", gain=30, after="0-9+"),
    Kind("secret", r"AKIA[0-9A-Z]{16}|password=[^\x20\x09-\x0D]+", 80, guard="(contains(_t, 'AKIA') OR contains(_t, 'password='))"),
)
KINDS = BASE + EXTRA

_SPAN = "array<struct<kind:string,start:int,end:int,score:int>>"


def _places(kind: Kind) -> str:
    """Spans of the matches in _m_<kind>, with their text m and the character b before them."""
    span = "named_struct('start', s.at + char_length(x.g), 'end', s.at + char_length(x.g) + char_length(x.m), 'm', x.m, 'b', right(x.g, 1))"
    return (
        f"aggregate(slice(zip_with(_m_{kind.name}, split(_t, r'{kind.pattern}', -1), (m, g) -> named_struct('m', m, 'g', g)), 1, size(_m_{kind.name})), "
        "named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,end:int,m:string,b:string>>)), "
        f"(s, x) -> named_struct('at', s.at + char_length(x.m) + char_length(x.g), 'out', concat(s.out, array({span}))), s -> s.out)"
    )


def _kept(kind: Kind) -> str:
    return f"({kind.keep})" + (f" AND NOT x.b RLIKE '[{kind.after}]'" if kind.after else "")


def _scored(kind: Kind) -> str:
    score = str(kind.prior)
    if kind.context:
        around = f"lower(substr(_t, greatest(x.start - {BEFORE}, 0) + 1, x.end - x.start + {BEFORE + AFTER}))"
        score += f" + CASE WHEN {around} RLIKE '(?:^|[^a-z])(?:{kind.context})' THEN {kind.gain} ELSE 0 END"
    return f"transform(filter({_places(kind)}, x -> {_kept(kind)}), x -> named_struct('kind', '{kind.name}', 'start', x.start, 'end', x.end, 'score', {score}))"


def _joined(spans: str, what: str = "concat(x.kind, ':', x.start, ':', x.end)") -> str:
    return f"array_join(transform({spans}, x -> {what}), ',')"


def find_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry, _t (the text, never null), and the arrays `base` and `extra` of (kind, start, end, score)."""
    none = f"CAST(array() AS {_SPAN})"
    got = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    matches = [f"CASE WHEN {k.guard} THEN regexp_extract_all(_t, r'{k.pattern}', 0) ELSE CAST(array() AS array<string>) END AS _m_{k.name}" for k in KINDS]
    got = got.selectExpr("*", *matches)
    spans = [f"CASE WHEN size(_m_{k.name}) = 0 THEN {none} ELSE {_scored(k)} END AS _s_{k.name}" for k in KINDS]
    got = got.selectExpr(*carry, "_t", *spans)
    got = got.selectExpr("*", f"concat({', '.join(f'_s_{k.name}' for k in BASE)}) AS base")
    free = f"x -> x.score >= {LEAST_SCORE} AND NOT exists(base, b -> b.start < x.end AND x.start < b.end)"
    return got.selectExpr(*carry, "_t", *[f"cast(size(_s_{k.name}) AS bigint) AS n_{k.name}" for k in BASE], "base", f"filter(concat({', '.join(f'_s_{k.name}' for k in EXTRA)}), {free}) AS extra")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets (overlapping ones by the first), and n_chars as it is then.

    A null text stays null.
    """
    plain, back = common.masked(docs, "text", "n_chars")
    carry = plain.columns
    ordered = "array_sort(concat(base, extra), (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.end > b.end THEN -1 WHEN a.end < b.end THEN 1 ELSE 0 END)"
    text = (
        f"aggregate({ordered}, named_struct('at', 0, 'out', CAST(array() AS array<string>)), "
        "(s, x) -> CASE WHEN x.start >= s.at THEN named_struct('at', x.end, 'out', concat(s.out, array(substr(_t, s.at + 1, x.start - s.at), concat('<', upper(x.kind), '>')))) "
        "ELSE named_struct('at', greatest(s.at, x.end), 'out', s.out) END, "
        "s -> concat(array_join(s.out, ''), substr(_t, s.at + 1)))"
    )
    found = find_spans(plain, carry).selectExpr(*carry, "_t", f"CASE WHEN size(base) + size(extra) = 0 THEN text ELSE {text} END AS _clean")
    put = {"text": "_clean AS text", "n_chars": "cast(char_length(_clean) AS bigint) AS n_chars"}
    return found.selectExpr(*[put.get(c, c) for c in carry]).select(*back)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return found.selectExpr("doc_id", *[f"n_{k.name}" for k in BASE], f"sha2({_joined('base')}, 256) AS base_sha256", f"{_joined('concat(base, extra)')} AS spans", f"{_joined('concat(base, extra)', 'x.score')} AS scores")


def _oracle() -> str:
    """The same in DuckDB's SQL, whose lists are summed up where Spark folds them."""
    digits = "reverse(regexp_replace(x.m, '[ -]', '', 'g'))"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN {digits}[i]::INT ELSE translate({digits}[i], '0123456789', '0246813579')::INT END for i in range(1, len({digits}) + 1)]) % 10 = 0"
    iban = "regexp_replace(x.m, '[^A-Z0-9]', '', 'g')"
    turned = f"({iban}[5:] || {iban}[:4])"
    mod97 = f"list_reduce([CASE WHEN {turned}[i] >= 'A' THEN ascii({turned}[i]) - 55 ELSE {turned}[i]::INT END for i in range(1, len({turned}) + 1)], lambda a, c: CASE WHEN c >= 10 THEN (a * 100 + c) % 97 ELSE (a * 10 + c) % 97 END) = 1"
    keep = {
        "email": "true",
        "ip": f"regexp_full_match(x.m, '{_BYTE}(?:\\.{_BYTE}){{3}}')",
        "card": f"CASE WHEN len({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END",
        "phone": "len(regexp_replace(x.m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": mod97,
        "ssn": "regexp_full_match(x.m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
        "local": "len(x.m) = 14",
        "secret": "true",
    }
    found = ", ".join(f"regexp_extract_all(t, '{k.plain or k.pattern}') AS m_{k.name}, string_split_regex(t, '{k.plain or k.pattern}') AS g_{k.name}" for k in KINDS)
    sizes = ", ".join(f"[len(x) for x in m_{k.name}] AS ml_{k.name}, [len(x) for x in g_{k.name}] AS gl_{k.name}" for k in KINDS)
    at = "(list_sum(gl_{0}[1:i]) + coalesce(list_sum(ml_{0}[1:i - 1]), 0))"
    raw = ", ".join(f"[{{'s': {at.format(k.name)}, 'e': {at.format(k.name)} + ml_{k.name}[i], 'm': m_{k.name}[i], 'b': right(g_{k.name}[i], 1)}} for i in range(1, len(m_{k.name}) + 1)] AS r_{k.name}" for k in KINDS)

    def scored(k: Kind) -> str:
        score = str(k.prior)
        if k.context:
            score += f" + CASE WHEN regexp_matches(lower(substr(t, (greatest(x.s - {BEFORE}, 0) + 1)::BIGINT, (x.e - x.s + {BEFORE + AFTER})::BIGINT)), '(?:^|[^a-z])(?:{k.context})') THEN {k.gain} ELSE 0 END"
        test = keep[k.name] + (f" AND NOT regexp_matches(x.b, '[{k.after}]')" if k.after else "")
        return f"[{{'kind': '{k.name}', 's': x.s::BIGINT, 'e': x.e::BIGINT, 'score': ({score})::INT}} for x in r_{k.name} if {test}] AS s_{k.name}"

    base = " || ".join(f"s_{k.name}" for k in BASE)
    extra = " || ".join(f"s_{k.name}" for k in EXTRA)
    text = "array_to_string([x.kind || ':' || x.s || ':' || x.e for x in {0}], ',')"
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, t, {found} FROM doc),
sized AS (SELECT *, {sizes} FROM found),
raw AS (SELECT doc_id, t, {raw} FROM sized),
scored AS (SELECT doc_id, {", ".join(map(scored, KINDS))} FROM raw),
joined AS (SELECT *, {base} AS base, {extra} AS more FROM scored),
kept AS (SELECT *, [x for x in more if x.score >= {LEAST_SCORE} AND len([y for y in base if y.s < x.e AND x.s < y.e]) = 0] AS extra FROM joined)
SELECT doc_id, {", ".join(f"len(s_{k.name}) AS n_{k.name}" for k in BASE)}, sha256({text.format("base")}) AS base_sha256,
  {text.format("(base || extra)")} AS spans, array_to_string([x.score for x in (base || extra)], ',') AS scores
FROM kept
"""


ORACLE = _oracle()

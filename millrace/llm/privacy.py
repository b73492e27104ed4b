"""Personal data: fixed formats, and looser candidates judged by boosted trees. DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Base formats. Possessive repeats and the look-behinds find the same matches as the plain forms
#: ([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on), in time proportional to the text:
#: a match begins where a run of its characters begins, or where the match before has ended (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: How the keys of well-known services begin.
KEYS = r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[baprs]-|AIza|eyJ)"
#: An announcing word and what stands between it and its value.
_WORD = r"(?i:passw(?:or)?d|passwort|passphrase|pwd|secret|token|(?:api|access|private)[_-]?key|auth|credentials?)"
_BEFORE_VALUE = "(?:" + _WORD + r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}|(?i:bearer)\x20)[\"']?"
#: Generators of further candidates: they find too much, the trees decide.
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_+/=-])(?:" + KEYS + r"[A-Za-z0-9_+/=.-]{11,}[A-Za-z0-9_=-]|(?:[A-Za-z_]++=)?[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/=-]{7,})",
    "email_loose": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "phone_loose": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "id_number": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{9,19})(?![0-9A-Za-z-])",
    "value": _BEFORE_VALUE + r"[^\s\"']*[^\s\"'.,;)\]}>]",
    "letters": r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z_+/=-]{16,}+(?![0-9@])",
}
#: Kinds whose spans are secrets too, and the base formats that two kinds are loose forms of.
_SECRET = ("value", "letters")
_FORM_OF = {"email_loose": "email", "phone_loose": "phone"}
#: What must occur in a text for a pattern to be tried at all.
_NEEDS = {"email": ("@",), "phone": ("+",), "email_loose": ("@", "[at]", "(at)"), "value": ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")}
#: Patterns that need a digit.
_DIGITS = ("ip", "card", "phone", "secret", "phone_loose", "id_number")
#: Words that announce a credential or personal data, as context features.
_SAID = r"(?i)(?:passw(?:or)?d|passwort|passphrase|pwd|secret|token|(?:api|access|private)[_-]?key|\bkey|auth|bearer|credentials?)"
_PERSONAL = r"(?i)(?:ssn|iban|passport|account|phone|tel|mobile|call|e-?mail|contact|write to)\W{0,6}$"
FEATURES = [
    "chars", "digits", "uppers", "lowers", "others", "hex_only", "switches", "distinct", "mixed_case", "case_changes",
    "said", "assigned", "colon", "before_quote", "after_quote", "personal", *(f"is_{k}" for k in LOOSE),
]
#: Elements that running values are taken over at once, and characters in a block of a cut text.
_BLOCK, _CHARS = 128, 4096
_SPANS = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` is ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, combine: str) -> str:
    """SQL: running values of an ``array<int>``, where ``combine`` joins ``{a}`` and ``{b}`` (a sum or maximum from 0 on).

    First inside blocks, then over the blocks' last values: Spark copies a fold's state at each step, so no state may be long.
    """
    step = f"(acc, x) -> named_struct('at', {combine.format(a='acc.at', b='x')}, 'out', acc.out || array({combine.format(a='acc.at', b='x')}))"
    fold = lambda part: f"aggregate({part}, named_struct('at', 0, 'out', cast(array() AS array<int>)), {step}, acc -> acc.out)"
    blocks = f"transform(sequence(0, size(rw) - 1, {_BLOCK}), k -> {fold(f'slice(rw, k + 1, {_BLOCK})')})"
    before = fold("transform(rb, b -> element_at(b, -1))")
    joined = f"flatten(transform(rb, (b, k) -> CASE WHEN k = 0 THEN b ELSE transform(b, v -> {combine.format(a='ro[k - 1]', b='v')}) END))"
    scan = _let("rb", blocks, _let("ro", before, joined))
    return _let("rw", values, f"CASE WHEN size(rw) > 0 THEN {scan} ELSE cast(array() AS array<int>) END")


def _each(matched: str, pattern: str) -> str:
    """SQL: ``start, end, text, before, after`` of the matches, from them and the pieces of text between them, in code points.

    ``before`` is up to 24 characters in front of a match (back to the start of the match before it), ``after`` the next one.
    """
    ends = running(f"zip_with({matched}, slice(ps, 1, size({matched})), (m, g) -> length(m) + length(g))", "{a} + {b}")
    one = (
        f"named_struct('start', es[i] - length(m), 'end', es[i], 'text', m, 'before', right(coalesce(get({matched}, i - 1), '') || ps[i], 24), 'after', left(ps[i + 1], 1))"
    )
    found = _let("ps", f"split(text, {_quoted(pattern)}, -1)", _let("es", ends, f"transform({matched}, (m, i) -> {one})"))
    return f"CASE WHEN size({matched}) > 0 THEN {found} ELSE cast(array() AS {_SPANS}) END"


def _matches(kind: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches in column ``text``, looked for only where what the pattern needs occurs."""
    found, seen = f"regexp_extract_all(text, {_quoted(pattern)}, 0)", []
    if kind in _NEEDS:
        where = "lower(text)" if kind == "value" else "text"
        seen.append("(" + " OR ".join(f"contains({where}, {_quoted(x)})" for x in _NEEDS[kind]) + ")")
    if kind in _DIGITS:
        seen.append("has_digit")
    return f"CASE WHEN {' AND '.join(seen)} THEN {found} ELSE cast(array() AS array<string>) END" if seen else found


#: SQL of the checks that a base match ``m`` must pass.
_VALID = {
    "ip": r"forall(split(m.text, '\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_to_number(right('000' || p, 3), '999'), 0) <= 255)",
    "card": "length(translate(m.text, ' -', '')) BETWEEN 16 AND 19 AND luhn_check(translate(m.text, ' -', ''))",
    "phone": "length(translate(m.text, '+ ().-', '')) BETWEEN 8 AND 15",
}


def _apart(found: str, base: str, overlap: bool) -> str:
    """SQL: those of ``found`` that lie within no base span (with ``overlap``: that overlap none), by one sweep over sorted places.

    Before a candidate's start (its end, with ``overlap``) the base spans that begin are known, and with them how far they reach.
    """
    event = "named_struct('at', {}, 'who', {}, 'end', {}, 'i', {})".format
    of_base = f"transform({base}, b -> {event('b.start', int(overlap), 'b.end', '-1')})"
    own = f"transform(af, (c, i) -> {event('c.end' if overlap else 'c.start', int(not overlap), 'c.start + 1' if overlap else 'c.end', 'i')})"
    reach = running("transform(ev, e -> CASE WHEN e.i < 0 THEN e.end ELSE 0 END)", "greatest({a}, {b})")
    left = f"filter(zip_with(ev, {reach}, (e, r) -> CASE WHEN e.i >= 0 AND r < e.end THEN e.i END), i -> i IS NOT NULL)"
    sweep = _let("ev", f"array_sort({of_base} || {own})", f"transform(array_sort({left}), i -> af[i])")
    return _let("af", found, f"CASE WHEN size({base}) = 0 OR size(af) = 0 THEN af ELSE {sweep} END")


def _evidence() -> str:
    """SQL: what the characters of a candidate ``m`` say, whatever stands around it: 1 for, 0 against, null if nothing."""
    like = lambda p: f"m.text RLIKE {_quoted(p)}"
    ends = like(r"(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z]{2,}$")
    # check digits of bank accounts: the number modulo 97 with letters as 10 to 35 and the head at the end
    moved = "split(substring(translate(m.text, ' ', ''), 5) || left(m.text, 4), '')"
    number = f"aggregate({moved}, 0, (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"
    digest = f"({like('^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$')} AND {like('[0-9]')} AND {like('[A-Fa-f]')})"
    random = f"(length(m.text) >= 20 AND {like('[a-z]')} AND {like('[A-Z]')} AND {like('[0-9].*[A-Za-z].*[0-9]')} AND NOT {like('[-./].*[-./]')})"
    plain = f"({like('^[0-9]+(?:[-._/:+][0-9]+)*$')} OR {like('^[A-Za-z]?[a-z]+(?:[-_/+][A-Za-z]?[a-z]+)*[-_]?[0-9]{0,4}$')} OR {like('^[A-Z]+$')})"
    return f"""cast(CASE WHEN m.known THEN 1
        WHEN m.kind = 'email_loose' THEN CASE WHEN NOT {ends} THEN 0 WHEN {like('[A-Za-z].*(?:@|at)')} THEN 1 END
        WHEN m.kind = 'phone_loose' THEN CASE WHEN {like('^(?:19|20)[0-9]{2}[^0-9]')} THEN 0 END
        WHEN m.kind = 'id_number' THEN CASE WHEN {like('^[A-Z]{2}[0-9]{2}')} THEN if({number} = 1, 1, 0)
            WHEN {like('^[0-9]{3}-[0-9]{2}-[0-9]{4}$')} THEN if({like('^(?:000|666|9)|-00-|-0000$')}, 0, 1) WHEN NOT luhn_check(m.text) THEN 0 END
        WHEN {digest} OR {random} OR {like('^' + KEYS + '[A-Za-z0-9_+/=.-]{12}')} THEN 1 WHEN m.kind <> 'value' AND {plain} THEN 0 END AS double)"""


def _described() -> str:
    """SQL: a candidate ``m`` with format and context features; ``announced`` is what evidence there is, ``known`` marks base spans."""
    like, stands = lambda p: f"m.text RLIKE {_quoted(p)}", lambda p: f"m.before RLIKE {_quoted(p)}"
    share = lambda p: f"regexp_count(m.text, {_quoted(p)}) / length(m.text)"
    values = {
        "chars": "length(m.text)", "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share("[^0-9A-Za-z]"),
        "hex_only": like("^(?:[A-Za-z_]+=)?[0-9a-f]+$"), "switches": share("[0-9][A-Za-z]|[A-Za-z][0-9]"), "distinct": "size(array_distinct(split(m.text, '')))",
        "mixed_case": f"{like('[a-z]')} AND {like('[A-Z]')}", "case_changes": share("[a-z][A-Z]|[A-Z][a-z]"), "said": f"{stands(_SAID)} OR {like(_SAID + '=')}",
        "assigned": stands(r"=>?\s{0,3}[\"']?$") + " OR " + like("^[A-Za-z_]+="), "colon": stands(r":\s{0,3}[\"']?$"), "before_quote": stands("[\"']$"), "after_quote": "m.after IN ('\"', '\\'')", "personal": stands(_PERSONAL),
    }
    values |= {f"is_{k}": f"m.kind = '{k}'" for k in LOOSE}
    return f"named_struct('kind', m.kind, 'start', m.start, 'end', m.end, 'known', m.known, 'announced', {_evidence()}, {', '.join(f"'{k}', cast({v} AS double)" for k, v in values.items())})"


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, base, loose)``: checked base spans, and candidates with the features the trees use.

    The looser candidates may overlap or contain base spans, but none lies within one; within a kind they don't overlap.
    A loose email or phone that overlaps a base one is the same value with more words, and left out. Base spans of the kinds
    that have a loose form are among ``loose`` too, marked ``known``: the trees learn from them, and never choose them.
    Every step is linear in a text's length and matches (sorting apart).
    """
    kept = [c for c in docs.columns if c in keep and c not in ("doc_id", "text")]
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.struct(*kept, F.lit(0).alias("_")).alias("rest"), text.alias("text"), F.rlike(text, F.lit("[0-9]")).alias("has_digit"))
    raw = read.selectExpr("*", *(f"{_matches(k, p)} AS m_{k}" for k, p in (BASE | LOOSE).items()))
    skip = f"regexp_extract(m.text, {_quoted('^' + _BEFORE_VALUE)}, 0)"
    value = _let("p", skip, "named_struct('start', m.start + length(p), 'end', m.end, 'text', substring(m.text, length(p) + 1), 'before', right(m.before || p, 24), 'after', m.after)")
    of = {k: _each(f"m_{k}", p) for k, p in (BASE | LOOSE).items()}
    of |= {k: f"filter({of[k]}, m -> {check})" for k, check in _VALID.items()}
    of |= {"value": f"transform({of['value']}, m -> {value})", "letters": f"filter({of['letters']}, m -> size(array_distinct(split(m.text, ''))) >= 8)"}
    typed = raw.selectExpr("doc_id", "rest", "text", *(f"{v} AS {k}" for k, v in of.items()))

    def named(source: str, kind: str, known: str = "false") -> str:
        return f"transform({source}, m -> named_struct('kind', '{kind}', 'known', {known}, 'start', m.start, 'end', m.end, 'text', m.text, 'before', m.before, 'after', m.after))"

    base = " || ".join(f"transform({k}, m -> named_struct('kind', '{k}', 'start', m.start, 'end', m.end))" for k in BASE)
    apart = (_apart(k, form, True) + f" AS {k}" for k, form in _FORM_OF.items())
    typed = typed.selectExpr("doc_id", "rest", "text", *(k for k in of if k not in _FORM_OF), f"{base} AS base", *apart)
    loose = _apart(" || ".join(named(k, k) for k in LOOSE), "base", False)
    sure = (named(source, k, "true") for k, source in (*_FORM_OF.items(), ("id_number", "card")))
    typed = typed.selectExpr("doc_id", "rest", "text", "base", f"{' || '.join((loose, *sure))} AS found")
    wanted = {"text": F.col("text")} | {c: F.col(f"rest.{c}") for c in kept}
    return typed.select("doc_id", *(wanted[c].alias(c) for c in docs.columns if c in keep and c != "doc_id"), "base", F.expr(f"transform(found, m -> {_described()})").alias("loose"))


def seeds(spark: SparkSession, variants: int = 40) -> DataFrame:
    """``(doc_id, text, good, held)``: made-up lines, so that every kind has examples however few a table holds.

    Lines that are ``held`` are worded otherwise than those the trees are fitted on: the thresholds are measured on them in odd
    variants, and ``report`` in even ones.
    """
    i = F.col("id")
    sha, b64 = F.sha1(i.cast("string")), F.base64(F.unhex(F.md5(i.cast("string"))))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), F.pmod(i, F.lit(len(words))))
    letters = F.translate(F.md5(i.cast("string")), "0123456789abcdef", "enrstialodguchmb")
    mixed = F.translate(F.md5(i.cast("string")), "0123456789abcdef", "QwErTyUiOpaSdFgH")
    word = pick("hunter", "Secret", "dragon", "Summer", "letme", "Qwerty", "Tr0ub4dor&", "pass#")
    good = [
        text("set password=", word, i, " now"), text("pwd: ", word, i + 2, "."), text("password: ", word, "&", i), text("pwd=", F.left(sha, F.lit(14)), " here"), text('token = "', sha, '" end'),
        text('token = "', F.left(sha, F.lit(18)), '" end'), text("api_key: ", b64, " end"), text("api_key: ", F.left(b64, F.pmod(i, F.lit(9)) + 10), " end"), text("password: ", F.left(b64, F.pmod(i, F.lit(7)) + 7), " ok"), text("key AKIA", F.upper(F.left(sha, F.lit(16))), " end"), text("use ghp_", F.left(mixed, F.lit(24)), i, " end"),
        text("see ", sha, " there"), text("see ", F.sha2(i.cast("string"), 256)), text('"secret": "', b64, '"'), text("Authorization: bearer ", b64), text('token = "', F.left(mixed, F.lit(16)), '"'),
        text("secret_key='", mixed, "'"), text("write to ", word, i, " [at] host", i, " [dot] com"), text("mail ", word, i, " @ host", i, ".org"), text("call (4", i + 10, ") 555-0", i + 100),
        text("phone: 4", i + 10, " 555 0", i + 100), text("ssn 1", i + 20, "-45-6", i + 700), text("iban DE89 3704 0044 0532 01", i + 10, " 00"),
    ]
    bad = [
        text("on 20", i + 10, "-03-1", i % 9, " we met"), text("version 1.", i, ".", i * 7919 + 1000000, " of it"), text("order ", i * 104729 + 123456789, " shipped"), text("the ", letters, " of"),
        text("der ", F.left(letters, F.lit(18)), "heit ist"), text("the password: none was set"), text("secret: please ask"), text("the token: ", pick("unknown", "nothing", "everybody", "later"), " said"),
        text("the key: ", pick("patience", "practice", "is", "to"), " learn"), text("chapter-", i, "-section-10000", i), text("file_2024_", i, "0000_final"), text("isbn 978-3-16-148", i + 100, "-0"), text("a/path/to/file", i, "0000000"),
        text("sold 3 @ 5.", i, " each"), text("in 2019 555 30", i + 10, " units"), text("auth: ", pick("required", "optional", "failed")), text("section 12345", i, "678 says"), text("ISO-8859-", i, "-2024-0001"),
    ]
    held_good = [
        text("the login uses passwd = '", word, i * 31, "!' today"), text("Passwort: ", F.initcap(F.left(letters, F.lit(6))), i, "#x"), text("client secret: ", F.base64(F.unhex(F.sha1((i + 500).cast("string")))), " (old)"), text("auth=", F.md5((i + 500).cast("string")), ";"),
        text("commit of ", F.sha1((i + 500).cast("string")), ", they said"), text("header: bearer ", F.left(F.base64(F.unhex(F.sha1((i + 900).cast("string")))), F.lit(22)), "x"), text("private_key => '", F.right(mixed, F.lit(20)), "'"),
        text("reach ", F.left(letters, F.lit(6)), "(at)mail", i, "(dot)net today"), text("e-mail: ", F.left(letters, F.lit(5)), ".x @ post", i, ".de"), text("contact ", F.left(letters, F.lit(7)), "@site", i, " [dot] edu"),
        text("mobile 017", F.pmod(i, F.lit(10)), " 555 0", i + 200), text("tel. 030-555-0", i + 300), text("my number (0", i + 30, ") 444.2", i + 100), text("account GB29 NWBK 6016 1331 92", i + 20, " 19"), text("social security 2", i + 30, "-61-", i + 4000),
    ]
    held_bad = [
        text("released 2023-11-0", i % 9, " as build ", i * 7919 + 20000000), text("bought 2 @ 3.", i + 10, " euros"), text("rated @ 4.", i, ".1 of ten"), text("from 1998 300 4", i + 10, " people came"), text("since 2004-555-20", i + 10, " no change"),
        text("sku ", i * 15485863 + 987654320, " in stock"), text("isbn 978316148", i + 1000, " again"), text("backup_2023_10_", i, "_full_copy"), text("mod_rewrite-", i, "-rules-2023000"), text("Wir sehen ", F.initcap(letters), "ung heute"), text("and ", F.left(letters, F.lit(10)), "-", F.right(letters, F.lit(9)), " too"),
        text("password: ", pick("optional", "required", "forgotten", "missing")), text("token: ", pick("the", "see", "no", "an"), " next page"), text("secret: ", pick("never", "nobody", "always", "still"), " tell"), text("access key: ", pick("below", "above", "expired", "hidden")),
    ]
    parts = ((good, 1.0, False), (bad, 0.0, False), (held_good, 1.0, True), (held_bad, 0.0, True))
    lines = F.array(*(F.struct(t.alias("text"), F.lit(g).alias("good"), F.lit(h).alias("held")) for part, g, h in parts for t in part))
    return spark.range(variants).select((-1 - i).alias("doc_id"), F.explode(lines).alias("x")).select("doc_id", "x.*")


class Judge:
    """The fitted trees as one SQL expression per candidate, and the threshold of each kind."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def margin(self, prefix: str) -> str:
        """SQL: the trees' weighted sum; ``prefix`` (``c.`` or nothing) is where the features are."""

        def node(x) -> str:
            if isinstance(x, float):
                return f"{x!r}D"
            feature, limit, left, right = x
            return f"CASE WHEN {prefix}{FEATURES[feature]} <= {limit!r}D THEN {node(left)} ELSE {node(right)} END"

        return " + ".join(f"{w!r}D * {node(t)}" for w, t in self.trees)

    def accepts(self) -> str:
        """SQL: every span ``c`` beyond the base ones must reach its kind's threshold; nothing else lets it in."""
        limits = " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in self.thresholds.items() if math.isfinite(v))
        return f"NOT c.known AND coalesce({self.margin('c.')} >= CASE c.kind {limits} END, false)" if limits else "false"


def _tree(node) -> object:
    """A fitted tree as nested ``(feature, limit, left, right)``; leaves are numbers."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def planted(spark: SparkSession) -> DataFrame:
    """``(announced, held, odd, known, kind, *FEATURES)`` of all candidates in the made-up lines; bounded."""
    found = candidates(seeds(spark), ("good", "held")).select("doc_id", "good", "held", F.explode("loose").alias("c"))
    return found.select(F.col("good").alias("announced"), "held", (F.pmod("doc_id", F.lit(2)) == 1).alias("odd"), "c.known", "c.kind", *(f"c.{f}" for f in FEATURES))


def fit(found: DataFrame, sample: int = 20000, precision: float = 0.9, rounds: int = 12, depth: int = 4, prior: float = 20.0) -> Judge:
    """Boosted trees on the seeds and on at most ``sample`` candidates with evidence for and ``sample`` with evidence against.

    Nobody labels spans here. Evidence is what a candidate's own characters prove (a valid base span or check digits, a digest's
    length and alphabet, a service's key; dates, versions, plain numbers and words), never the words around it: those are
    features. Candidates without evidence aren't learnt from. Seeds weigh a fifth of the whole.

    The thresholds are measured on all candidates with evidence but those the trees were fitted on, each class of a kind weighed
    back to its count in the whole table, and on made-up lines that are kept out of the fit. In a class of a kind of which the table
    proves n cases these weigh ``prior * prior / (prior + n)`` cases, the less the more there are of the table's own. Each kind gets
    the lowest threshold that reaches ``precision`` on both together with five cases' weight, and takes nothing if there is none.
    No number of cases changes how a threshold is found.
    """
    spark = found.sparkSession
    every = found.select("doc_id", F.explode("loose").alias("c")).select("doc_id", "c.*").withColumn("order", F.xxhash64("doc_id", "kind", "start"))
    proven = every.filter("announced IS NOT NULL")
    sampled = stored(proven.filter("announced = 1").orderBy("order").limit(sample).unionByName(proven.filter("announced = 0").orderBy("order").limit(sample)), "privacy-sample")
    made_up = stored(planted(spark), "privacy-seeds").coalesce(1)
    given = made_up.filter("NOT held")
    learn = sampled.filter("order % 2 = 0")
    weight = max(1.0, learn.count() / 4 / max(1, given.count()))
    both = learn.select("announced", *FEATURES, F.lit(1.0).alias("weight")).unionByName(given.select("announced", *FEATURES, F.lit(weight).alias("weight")))
    both = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both).coalesce(8)
    model = GBTClassifier(labelCol="announced", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=11).fit(both)
    judge = Judge([(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)], {})
    last = {r["announced"]: r["last"] for r in sampled.groupBy("announced").agg(F.max("order").alias("last")).collect()}
    unseen = (F.col("order") % 2 != 0) | (F.col("order") > F.when(F.col("announced") > 0, last.get(1.0, 2**63 - 1)).otherwise(last.get(0.0, 2**63 - 1)))
    is_good, n = F.col("announced") > 0, lambda c: F.count(F.when(c, 1))
    sums = {"good": n(is_good & unseen), "bad": n(~is_good & unseen), "all_good": n(is_good), "all_bad": n(~is_good)}
    margin = F.round(F.expr(judge.margin("")), 3).alias("margin")
    tested = (proven.filter("NOT known") if "known" in proven.columns else proven).select("kind", "order", "announced", margin).groupBy("kind", "margin").agg(*(c.alias(k) for k, c in sums.items()))
    lines = made_up.filter("held AND odd AND NOT known").select("kind", "announced", margin).groupBy("kind", "margin").agg(n(is_good).alias("good"), n(~is_good).alias("bad"))
    measured, made = ({k: [] for k in LOOSE} for _ in range(2))
    for rows, levels in ((tested, measured), (lines, made)):
        for r in rows.collect():  # at most one row for each combination of leaves
            levels[r["kind"]].append((r["margin"], *(r[k] for k in rows.columns[2:])))
    for kind in LOOSE:
        seen_good, seen_bad, all_good, all_bad = (sum(level[i] for level in measured[kind]) for i in range(1, 5))
        line_good, line_bad = (sum(level[i] for level in made[kind]) for i in (1, 2))
        cases = [(m, g * all_good / max(seen_good, 1), b * all_bad / max(seen_bad, 1)) for m, g, b, *_ in measured[kind]]
        line_good, line_bad = (prior * prior / (prior + n) / max(lines, 1) for n, lines in ((all_good, line_good), (all_bad, line_bad)))
        cases += [(m, g * line_good, b * line_bad) for m, g, b in made[kind]]
        judge.thresholds[kind] = lowest(cases, precision)
    return judge


def lowest(cases: list[tuple[float, float, float]], precision: float, least: float = 5.0) -> float:
    """The lowest positive margin from which on good cases are at least ``precision`` of all; infinite if there is none.

    Fewer than ``least`` cases prove nothing. ``cases`` are ``(margin, weight of good ones, weight of bad ones)``; equal margins are one level.
    """
    at: dict[float, tuple[float, float]] = {}
    for margin, good, bad in cases:
        before = at.get(margin, (0.0, 0.0))
        at[margin] = before[0] + good, before[1] + bad
    limit, whole, wrong = float("inf"), 0.0, 0.0
    for margin in sorted(at, reverse=True):
        whole, wrong = whole + at[margin][0], wrong + at[margin][1]
        if margin > 0 and whole + wrong >= least and whole >= precision * (whole + wrong):
            limit = float(margin) - 5e-4
    return limit


def report(judge: Judge, spark: SparkSession) -> DataFrame:
    """``(kind, n_good, n_bad, found, wrong, precision, recall)`` on made-up lines that neither trees nor thresholds have seen."""
    lines = planted(spark).filter("held AND NOT odd AND NOT known").withColumn("taken", F.expr(judge.accepts().replace("c.", "")))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    out = lines.groupBy("kind").agg(n("announced = 1").alias("n_good"), n("announced = 0").alias("n_bad"), n("taken AND announced = 1").alias("found"), n("taken AND announced = 0").alias("wrong"))
    return out.withColumns({"precision": F.try_divide("found", F.col("found") + F.col("wrong")), "recall": F.try_divide("found", "n_good")})


def chosen(judge: Judge) -> Column:
    """``array<struct<kind, start, end>>``: base spans and accepted candidates, which may overlap; of one within another the outer
    stays, of equal ones the first kind of ``LOOSE``. One sweep over sorted spans."""
    rank = "array(" + ", ".join(map(_quoted, LOOSE)) + ")"
    keyed = f"array_sort(transform(filter(loose, c -> {judge.accepts()}), c -> named_struct('start', c.start, 'far', -c.end, 'rank', array_position({rank}, c.kind), 'kind', c.kind)))"
    alone = _let("reach", running("transform(x1, c -> -c.far)", "greatest({a}, {b})"), "filter(x1, (c, i) -> i = 0 OR -c.far > reach[i - 1])")
    secret = ", ".join(map(_quoted, _SECRET))
    named = f"transform({alone}, c -> named_struct('kind', CASE WHEN c.kind IN ({secret}) THEN 'secret' ELSE c.kind END, 'start', c.start, 'end', -c.far))"
    return F.expr("base || " + _let("x1", keyed, named))


def find(docs: DataFrame, keep: tuple[str, ...] = (), judge: Judge | None = None) -> DataFrame:
    """``(doc_id, *keep, base, spans)`` for every document; ``spans`` are the base spans and those the trees add.

    The texts are read once and only places are stored; nothing is shuffled but the training sample. Nulls: a null text is empty, a
    null ``doc_id`` stays null. Long runs of one character cost no more than others. Repeated rows are searched each.
    Empty tables give an empty result. Other columns are ignored, unless named in ``keep``.
    """
    found = stored(candidates(docs, keep), "privacy")
    return found.withColumn("spans", chosen(judge or fit(found))).drop("loose")


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans are one, of the kind that begins first.

    ``text`` and ``spans`` are SQL. Linear: the text is split into blocks of a fixed number of characters, and what stays is cut
    from the blocks it lies in.
    """
    keyed = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'far', -s.end, 'kind', s.kind)))"
    begins = "filter(transform(x1, (s, i) -> CASE WHEN i = 0 OR s.start >= reach[i - 1] THEN i END), i -> i IS NOT NULL)"
    group = "named_struct('start', x1[i].start, 'end', coalesce(get(reach, get(bg, j + 1) - 1), reach[size(x1) - 1]), 'kind', x1[i].kind)"
    merged = _let("x1", keyed, _let("reach", running("transform(x1, s -> -s.far)", "greatest({a}, {b})"), _let("bg", begins, f"transform(bg, (i, j) -> {group})")))

    def cut(a: str, b: str) -> str:
        first = f"cast(floor({a} / {_CHARS}) AS int)"
        inside = f"array_join(slice(bl, {first} + 1, cast(floor(({b} - 1) / {_CHARS}) AS int) - {first} + 1), '')"
        return f"CASE WHEN {b} > {a} THEN substring({inside}, {a} - {first} * {_CHARS} + 1, {b} - {a}) ELSE '' END"

    parts = f"transform(mg, (s, i) -> {cut('coalesce(get(mg, i - 1).end, 0)', 's.start')} || '[' || upper(s.kind) || ']')"
    filled = f"array_join({parts}, '') || {cut('coalesce(get(mg, size(mg) - 1).end, 0)', f'length({text})')}"
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{_CHARS}}}', 0)"
    return F.expr(_let("mg", merged, _let("bl", blocks, filled)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind; all columns stay, ``n_chars`` follows the text, a null text stays null."""
    rest, null = [c for c in docs.columns if c != "text"], "_null"
    while null in rest:
        null += "_"
    found = find(docs.select("doc_id", "text", F.struct(*rest, F.col("text").isNull().alias(null)).alias("_row")), keep=("_row", "text"))
    out = found.withColumn("_new", F.when(F.size("spans") > 0, redacted("text", "spans")).when(~F.col(f"_row.{null}"), F.col("text")))
    value = {c: F.col(f"_row.{c}") for c in rest} | {"text": F.col("_new")}
    if "n_chars" in rest:
        value["n_chars"] = F.when(F.size("spans") > 0, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars"))
    return out.select(*(value[c].alias(c) for c in docs.columns))


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all ``documents``, and the counts of all spans and of those the trees add."""
    found = find(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    spans, added = F.size("spans").cast("long"), (F.size("spans") - F.size("base")).cast("long")
    return found.select("doc_id", *(number(k) for k in BASE), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), spans.alias("n_spans"), added.alias("n_added"))

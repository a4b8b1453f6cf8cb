"""Personal data by weak supervision, in DataFrame and SQL functions.

Candidate spans come from one pattern per kind. Labelers vote on each: regex (the strict
format holds), gazetteer (known endings, country codes, issuers, key prefixes), context
(words before the span that name such data) and edges (the span stands alone). Votes are 1,
-1 or 0 (abstains). Their counts by kind and vote pattern are a table of bounded size, on
which expectation-maximisation estimates each labeler's reliability. The posteriors it gives
train the final classifier (naive Bayes over votes, length and separators of a span), which
is applied to every candidate. Base kinds with a valid format are spans in any case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. The base patterns keep the language of the plain ones ("leftmost,
# non-overlapping") but never try a second start within a run and never backtrack.
_LOCAL = r"[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Prefixes of well-known keys; other keys are long hexadecimal numbers.
_PREFIXES = "(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk_test_|sk-|xox[bp]-)"
# Groups that repeat without bound are possessive: others recurse once for each repetition.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_written": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{1,63}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}+)++",
    "phone_local": r"(?<![+0-9()-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"(?<![A-Za-z0-9_-])(?:{_PREFIXES}[A-Za-z0-9_-]{{12,}}+|[0-9A-Fa-f]{{32,}}+(?![A-Za-z0-9_-]))",
}
BASE = ("email", "ip", "card", "phone")
#: A sign that any span of the kind holds; texts without it are not searched.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "email_written": "at", "national_id": "-", "phone_local": None, "card": None, "secret": None}
_STRICT = {
    "email": "true",
    "ip": rf"m rlike '^{_OCTET}(?:[.]{_OCTET})(?:[.]{_OCTET})(?:[.]{_OCTET})$'",
    "card": "length(regexp_replace(m, '[ -]', '')) between 16 and 19 and luhn_check(regexp_replace(m, '[ -]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 8 and 15",
    "email_written": r"m rlike '[A-Za-z]{2,12}$'",
    "phone_local": "m rlike '^[(]?[2-9][0-9]{2}[)]? ?[ .-]?[2-9]'",
    "national_id": "not m rlike '^(?:000|666|9)' and not m rlike '-00-' and not m rlike '-0000$'",
    "secret": "m rlike '[0-9]' and m rlike '[A-Za-z]'",
}
_KNOWN = {
    "email": r"lower(m) rlike '[.](?:com|org|net|edu|gov|info|io|example|test|de|fr|es|uk|eu|us)$'",
    "ip": r"not m rlike '^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]'",
    "card": "m rlike '^(?:3[47]|4|5[1-5]|2[2-7]|6)'",
    "phone": r"m rlike '^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])'",
    "email_written": r"lower(m) rlike '(?:com|org|net|edu|gov|info|io|example|test|de|fr|es|uk|eu|us)$'",
    "phone_local": "not m rlike '^[(]?(?:[0-9])11'",
    "national_id": "not m in ('123-45-6789', '078-05-1120')",
    "secret": f"m rlike '^{_PREFIXES}' or length(m) in (32, 40, 48, 64, 96, 128)",
}
_CONTEXT = {
    "email": "mail|contact|write to|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|master|credit|pay|karte|tarjeta|carte",
    "phone": "tel|phone|call|fax|mobile|contact|ruf",
    "email_written": "mail|contact|write to|kontakt|correo|courriel",
    "phone_local": "tel|phone|call|fax|mobile|contact|ruf",
    "national_id": "ssn|social|id|number|security",
    "secret": "key|token|secret|password|auth",
}
#: Matches of a text that are put together at a time.
BLOCK = 128
#: Column of the candidates.
CANDIDATES = "personal data candidates"
VOTES = ("regex", "gazetteer", "context", "edges")
_SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: str) -> str:
    """SQL for all matches of a kind in the text t, as an array of _SPAN; offsets in code points.

    Offsets are sums of the lengths of the pieces between matches and of the matches.
    """
    pattern, none = _quoted(PATTERNS[kind]), f"cast(array() as array<{_SPAN}>)"
    block = f"sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK - 1}, size(ms) - 1))"
    # a growing array is copied with each element: offsets are summed up by blocks, spans collected within them
    starts = (
        f"aggregate(sequence(0, (size(ms) - 1) div {BLOCK}), named_struct('at', 0, 'out', cast(array() as array<int>)), (a, b) -> named_struct("
        f"'at', a.at + aggregate({block}, 0, (n, i) -> n + length(ps[i]) + length(ms[i])), 'out', concat(a.out, array(a.at))), a -> a.out)"
    )
    spans = (
        f"aggregate({block}, named_struct('at', at, 'out', {none}), "
        "(a, i) -> named_struct('at', a.at + length(ps[i]) + length(ms[i]), 'out', concat(a.out, array(named_struct("
        "'s', a.at + length(ps[i]), 'e', a.at + length(ps[i]) + length(ms[i]), 'm', ms[i], 'before', right(ps[i], 40), 'after', left(ps[i + 1], 1))))), a -> a.out)"
    )
    pieces = f"transform(array(split(t, {pattern}, -1)), ps -> flatten(transform({starts}, (at, b) -> {spans})))[0]"
    need = _NEEDS[kind]
    guard = f"instr(t, '{need}') > 0" if need else "t rlike '[0-9]'"
    return f"if({guard}, transform(array(regexp_extract_all(t, {pattern}, 0)), ms -> if(size(ms) = 0, {none}, {pieces}))[0], {none})"


def _voted(kind: str) -> str:
    """SQL that turns a kind's matches in the text t into candidates with votes. In rules, m is the match."""
    votes = f"'regex', if({_STRICT[kind]}, 1, -1), 'gazetteer', if({_KNOWN[kind]}, 1, -1), 'context', if(lower(c.before) rlike {_quoted(_CONTEXT[kind])}, 1, 0)"
    return (
        f"transform({_matches(kind)}, c -> transform(array(c.m), m -> named_struct('kind', '{kind}', 's', c.s, 'e', c.e, {votes}, "
        "'edges', if((c.before = '' or c.before rlike '[^A-Za-z0-9]$') and (c.after = '' or c.after rlike '[^A-Za-z0-9]'), 1, -1), "
        "'size', cast(least(7, (c.e - c.s) div 6) as int), 'marks', if(m rlike '[ ()-]', 1, 0)))[0])"
    )


def candidate_spans(documents: DataFrame, text_col: str = "text", out: str = CANDIDATES) -> DataFrame:
    """documents with a column `out`: candidates of every kind with their votes and shape.

    Null and empty texts have none. Other columns stay as they are; one of the name `out` is replaced.
    """
    every = "concat(" + ", ".join(map(_voted, PATTERNS)) + ")"
    return documents.withColumn(out, F.expr(f"transform(array(coalesce(cast(`{text_col}` as string), '')), t -> {every})[0]"))


@dataclass(frozen=True)
class SpanModel:
    """Log odds of the final classifier: a prior by kind and weights by (feature, kind, value)."""

    prior: dict[str, float]
    weights: dict[tuple[str, str, int], float]
    reliability: dict[tuple[str, str], float]

    def accepted(self) -> str:
        """SQL over a candidate c: the classifier's log odds exceed 0."""
        if not self.prior:
            return "false"
        kinds = []
        for kind, prior in sorted(self.prior.items()):
            terms = [f"{prior:.6f}D"]
            for feature in (*VOTES, "size", "marks"):
                cases = " ".join(f"when {v} then {w:.6f}D" for (f, k, v), w in sorted(self.weights.items()) if (f, k) == (feature, kind))
                terms.append(f"case c.{feature} {cases} else 0D end")
            kinds.append(f"when '{kind}' then " + " + ".join(terms))
        return f"(case c.kind {' '.join(kinds)} else -1D end) > 0"


def estimate(counts: list[tuple], rounds: int = 40) -> SpanModel:
    """Expectation-maximisation over counts of vote patterns, then the final classifier.

    counts: (kind, regex, gazetteer, context, edges, size, marks, n) rows; there are at most
    8 kinds times 24 vote patterns times 16 shapes. Labelers of a kind are taken as
    independent given the truth; each vote has a probability under either truth.
    """
    prior, weights, reliability = {}, {}, {}
    for kind in sorted({c[0] for c in counts}):
        rows = [c for c in counts if c[0] == kind]
        total = sum(r[-1] for r in rows)
        # start: the share of labelers for the span, so that truth 1 keeps its meaning
        belief = [min(0.95, max(0.05, 0.5 + sum(r[1:5]) / 8)) for r in rows]
        for _ in range(rounds):
            mass = sum(b * r[-1] for b, r in zip(belief, rows, strict=True))
            table = {}
            for k in range(4):
                for value in (-1, 0, 1):
                    yes = sum(b * r[-1] for b, r in zip(belief, rows, strict=True) if r[1 + k] == value)
                    no = sum((1 - b) * r[-1] for b, r in zip(belief, rows, strict=True) if r[1 + k] == value)
                    table[k, value] = ((yes + 1) / (mass + 3), (no + 1) / (total - mass + 3))
            share = (mass + 1) / (total + 2)
            belief = []
            for r in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(table[k, r[1 + k]][0] / table[k, r[1 + k]][1]) for k in range(4))
                belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for k, name in enumerate(VOTES):
            right = share * table[k, 1][0] + (1 - share) * table[k, -1][1]
            reliability[kind, name] = right / max(1e-9, right + share * table[k, -1][0] + (1 - share) * table[k, 1][1])
        mass = sum(b * r[-1] for b, r in zip(belief, rows, strict=True))
        prior[kind] = math.log((mass + 1) / (total - mass + 1))
        for k, name in enumerate((*VOTES, "size", "marks")):
            values = sorted({r[1 + k] for r in rows})
            for value in values:
                yes = sum(b * r[-1] for b, r in zip(belief, rows, strict=True) if r[1 + k] == value)
                no = sum((1 - b) * r[-1] for b, r in zip(belief, rows, strict=True) if r[1 + k] == value)
                weights[name, kind, value] = math.log((yes + 1) / (mass + len(values))) - math.log((no + 1) / (total - mass + len(values)))
    return SpanModel(prior, weights, reliability)


def fit_spans(found: DataFrame, candidates: str = CANDIDATES) -> SpanModel:
    """Counts the vote patterns of all candidates of all documents and fits the model on them.

    found: what candidate_spans returns, stored, so that patterns are searched once.
    """
    rows = found.select(F.explode(F.col(f"`{candidates}`")).alias("c")).select("c.*")
    keys = ["kind", *VOTES, "size", "marks"]
    return estimate([tuple(r) for r in rows.groupBy(*keys).count().orderBy(*keys).collect()])


def label_spans(found: DataFrame, model: SpanModel, candidates: str = CANDIDATES, out: str = "spans") -> DataFrame:
    """found without candidates and with `out`: array of (kind, s, e), by kind as in PATTERNS, then by start.

    Offsets are code points, ends exclusive. Base kinds with a valid format are spans
    whatever the classifier says; other candidates are if it accepts them. Null and empty
    texts have none. A column named `out` of the input is replaced, others stay.
    """
    base = "c.kind in (" + ", ".join(f"'{k}'" for k in BASE) + ")"
    keep = f"if({base}, c.regex = 1, {model.accepted()})"
    spans = F.expr(f"transform(filter(`{candidates}`, c -> {keep}), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))")
    return found.withColumn(out, spans).drop(candidates)


def span_text(spans: str = "spans", kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of spans, joined by commas; kinds: only these."""
    chosen = f"filter(`{spans}`, c -> c.kind in ({', '.join(map(repr, kinds))}))" if kinds else f"`{spans}`"
    return F.expr(f"array_join(transform({chosen}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')")


def redacted(text_col: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge."""
    order = f"array_sort(transform(`{spans}`, c -> named_struct('s', c.s, 'e', c.e, 'kind', c.kind)))"
    step = f"(a, c) -> named_struct('out', concat(a.out, if(c.s >= a.at, concat(substring(`{text_col}`, a.at + 1, c.s - a.at), '<', c.kind, '>'), '')), 'at', greatest(a.at, c.e))"
    return F.expr(f"if(size(`{spans}`) = 0, `{text_col}`, aggregate({order}, named_struct('out', '', 'at', 0), {step}, a -> concat(a.out, substring(`{text_col}`, a.at + 1))))")

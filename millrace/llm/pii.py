"""Personal data by weak supervision, with DataFrame functions only.

Candidates are spans of four base kinds, found by fixed patterns and checks, and of looser
ones: digit chains of card length that fail the check sum, phone numbers without a country
code (two forms), names after a title, a given name or a word such as "Dear", long strings of
letters and digits that may be secrets, and account numbers. Base spans are always kept.
Whether a loose candidate is one as well is learnt without labels.

Five labelers (pattern, structure, gazetteer, words before, neighbours) vote yes, no or abstain
on each candidate of the corpus, or have no say on a kind of candidate. Expectation-maximisation
over the counts of vote patterns estimates, for each way of finding candidates, the share that is
right and how often each labeler votes yes, no and not at all on right and on wrong ones; so an
abstention counts for what it is worth. Weak priors make a vote for mean for, until the corpus says
otherwise. A logistic span classifier is trained on the posteriors, with votes, finder and
length as features, and its weights decide.

All candidates of all documents are counted, by pattern; the table of patterns is bounded by
the number of votes, finders and length classes (a few thousand rows), so it alone is gathered.

Positions come from a pair of native functions: what ``split`` leaves between the matches of
``regexp_extract_all`` gives each match its offset, in code points, by running sums that are
made block by block. Patterns are possessive and anchored at the start of a run (or at the end of
the match before), which finds the matches of the plain patterns in linear time. A text's
loose candidates are compared with its base spans, which takes the product of their numbers.

Defined results: a null text is empty; empty texts have no spans; repeated rows are judged
each; an empty table gives an empty result; further columns pass through, and those named
like a result column (``spans``, ``n_*``; for ``label`` also ``candidates``) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, without

KINDS = ("email", "ip", "card", "phone", "name", "secret", "iban")
BASE = KINDS[:4]
CONTEXT = 28
#: Length classes: a span is in class i if it has at least this many code points.
LENGTHS = (0, 8, 12, 16, 20, 32)
ROUNDS, STEPS = 60, 400
#: Elements of an array that are summed in a row.
BLOCK = 64
#: The vote of a labeler that has no say on a kind of candidate.
MUTE = 2

# The base patterns, in a form that scans a run once.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose patterns.
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mlle|Señor|Señora"
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Wolfgang Jürgen Stefan Andreas Petra Ursula Sabine Pierre François Jacques "
    "Philippe Nathalie Isabelle Sylvie Carlos José Miguel Francisco Alejandro Carmen Dolores Lucía Javier Guadalupe"
).split()
FAR_PHONE = r"(?<![0-9A-Za-z+.,/-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})(?:[\x20./-][0-9]{2,8}){1,4}(?![0-9A-Za-z-])"
CUES = "[Nn]ame|[Dd]ear|[Ss]igned|[Ss]incerely|[Nn]ombre|Nom|[Pp]atient|[Cc]ustomer"
NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:(?:{TITLES})\.?|(?:{'|'.join(GIVEN)}))\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?"
    rf"|(?<=(?:{CUES})[:,]?\x20)\p{{Lu}}\p{{Ll}}+\x20\p{{Lu}}\p{{Ll}}+)"
)
_RUN = r"[A-Za-z0-9_+/-]"
SECRET = (
    rf"(?<!{_RUN})(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])(?![A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?!{_RUN})){_RUN}{{16,}}+={{0,2}}(?![@=])"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
# Gazetteers.
TLDS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no dk fi pl pt br mx ar ca au nz jp cn in ru"
DIAL = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|85[0-6]|9[679][0-9])"
ISSUERS = r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"
IBAN_LENGTHS = (
    "AT20 BE16 CH21 CZ24 DE22 DK18 ES24 FI18 FR27 GB22 GR27 HU28 IE22 IT27 LU20 NL18 NO15 PL28 PT25 RO24 SE24 SK24"
).split()
ISSUED = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk_test_|sk-|pk_live_|eyJ)"
#: Words before a span that speak for its kind, and those that speak against it.
WORDS_FOR = {
    "email": "e-?mail|mail|contact|correo|courriel|write to",
    "ip": "ip|host|server|address|adresse|addr",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment",
    "phone": "tel|phone|call|fax|mobile|telefon|téléphone|teléfono|whatsapp",
    "name": "name|dear|sincerely|nombre|nom|signed|patient|customer",
    "secret": "token|secret|password|passwd|pwd|api|key|apikey|api_key|bearer|credentials?|auth",
    "iban": "iban|account|konto|cuenta|compte|bank|bic",
}
WORDS_AGAINST = "version|isbn|issn|order|invoice|token|hash|sha|build|release|license|section|serial"
SECRET_AGAINST = "commit|sha|sha1|sha256|md5|hash|digest|checksum|revision|etag|uuid|version|build|file|path|url"
LABELERS = ("pattern", "structure", "gazetteer", "before", "neighbours")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _octets(x: Column) -> Column:
    return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")


def _is_base(kind: str, x: Column) -> Column:
    """The base kind's own check of a match."""
    size = F.length(_digits(x))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(x)
    if kind == "card":
        return size.between(16, 19) & F.call_function("luhn_check", F.when(size.between(16, 19), _digits(x)).otherwise("1"))
    return size.between(8, 15)


def _iban_fits(x: Column) -> Column:
    """Whether the check digits are right: the number, its first four characters last and A as 10, leaves 1 by 97."""
    plain = F.regexp_replace(x, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    each = F.transform(F.split(turned, "(?!^)(?!$)"), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(each, F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _votes(kind: str, strict: bool, x: Column, before: Column, after: Column) -> dict[str, Column]:
    """The five labelers. ``strict``: the match is of the kind's base pattern."""
    size = F.length(_digits(x))
    never = F.lit(False)
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    out = {"pattern": _vote(_is_base(kind, x), ~_is_base(kind, x)) if strict else F.lit(MUTE)}
    against = WORDS_AGAINST
    glued = F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_#/]") | F.left(after, F.lit(1)).rlike(r"[\p{L}\p{N}_/]")
    out["neighbours"] = _vote(~glued, glued)
    if kind == "email":
        tld = F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1))
        out["structure"] = _vote(tld.rlike("^[a-z]{2,24}$"), ~tld.rlike("^[a-z]{2,24}$"))
        out["gazetteer"] = _vote(tld.isin(TLDS.split()), never)
    elif kind == "ip":
        out["structure"] = _vote(_octets(x), ~_octets(x))
        out["gazetteer"] = _vote(x.rlike(r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[0-2][0-9]|23[0-9])\."), x.rlike(r"^0"))
    elif kind == "card":
        luhn = F.call_function("luhn_check", F.when(size.between(13, 19), _digits(x)).otherwise("1"))
        out["structure"] = _vote(luhn, ~luhn)
        out["gazetteer"] = _vote(x.rlike(ISSUERS), ~x.rlike(ISSUERS))
    elif kind == "phone":
        usual = size.between(8, 15) if strict else size.between(9, 12)
        out["structure"] = _vote(usual, ~usual)
        out["gazetteer"] = _vote(x.rlike(DIAL), x.rlike(r"^\+") & ~x.rlike(DIAL)) if strict else F.lit(MUTE)
    elif kind == "name":
        out["structure"] = _vote(x.rlike(rf"^(?:{TITLES})\b"), never)
        given = x.rlike(rf"^(?:(?:{TITLES})\.?\x20)?(?:{'|'.join(GIVEN)})\b")
        out["gazetteer"] = _vote(given, never)
        first = F.trim(before).rlike(r"[.!?]$") | (F.trim(before) == "")  # a sentence begins here: capitals mean less
        out["neighbours"] = _vote(never, first)
    elif kind == "secret":
        mixed = (x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & F.length(x).isin(32, 40, 48, 64)) | (
            x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9].*[0-9]") & (F.length(x) >= 20)
        )
        words = x.rlike(r"(?:^|[_/-])[A-Za-z]{4,}(?:[_/-]|$)")
        out["structure"] = _vote(mixed & ~words, words)
        uuid = x.rlike("(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
        out["gazetteer"] = _vote(x.rlike(ISSUED), uuid)
        set_to = before.rlike(r"(?:[=:]\s?[\x22\x27]?|(?i:bearer)\s)$")
        out["neighbours"] = _vote(set_to, ~set_to & glued)
        against = SECRET_AGAINST
    else:
        out["structure"] = _vote(_iban_fits(x), ~_iban_fits(x))
        plain = F.regexp_replace(x, r"\x20", "")
        known = F.concat(F.left(plain, F.lit(2)), F.length(plain).cast("string")).isin(IBAN_LENGTHS)
        out["gazetteer"] = _vote(known, ~known)
    out["before"] = _vote(
        near.rlike(rf"(?<![\p{{L}}])(?:{WORDS_FOR[kind]})(?![\p{{L}}])"), near.rlike(rf"(?<![\p{{L}}])(?:{against})(?![\p{{L}}])")
    )
    return {name: out.get(name, F.lit(0)) for name in LABELERS}


#: (kind, pattern, whether it is the base pattern, a cheap condition without which nothing matches, which matches are candidates)
_FINDERS = (
    ("email", EMAIL, True, lambda t: F.contains(t, F.lit("@")), lambda x: F.lit(True)),
    ("ip", IP, True, lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets),
    ("card", CARD, True, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda x: F.length(_digits(x)).between(13, 19)),
    ("phone", PHONE, True, lambda t: F.contains(t, F.lit("+")), lambda x: F.length(_digits(x)).between(8, 15)),
    ("phone", LOCAL_PHONE, False, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), lambda x: F.lit(True)),
    ("phone", FAR_PHONE, False, lambda t: t.rlike(r"0[0-9]{1,4}\)?[\x20./-][0-9]"), lambda x: F.length(_digits(x)).between(8, 13)),
    ("name", NAME, False, lambda t: F.contains(t, F.lit(" ")), lambda x: F.lit(True)),
    ("secret", SECRET, False, lambda t: t.rlike(rf"{_RUN}{{16}}"), lambda x: F.length(x) <= 512),
    ("iban", IBAN, False, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), lambda x: F.length(F.regexp_replace(x, r"\x20", "")).between(15, 34)),
)


def _length_class(x: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(F.length(x) >= least, i).otherwise(out)
    return out


def _before(values: Column, op, zero: int) -> Column:
    """For each number of an array, those before it taken together by ``op``: block by block, so in near-linear time."""
    count = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
    empty = F.array().cast("array<int>")

    def step(acc: Column, v: Column) -> Column:
        return F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def run(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(zero).alias("at"), empty.alias("out")), step)

    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(empty)
    blocks = F.transform(starts, lambda b: run(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    ends = F.aggregate(
        F.transform(blocks, lambda b: b["at"]), F.struct(F.lit(zero).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]
    )
    return F.flatten(F.zip_with(blocks, ends, lambda b, e: F.transform(b["out"], lambda x: op(e, x))))


def _spans(number: int, matches: Column, gaps: Column, starts: Column) -> Column:
    """Candidate structs of one finder, in order. ``gaps``: what lies between the matches; ``starts``: where they begin."""
    kind, _, strict, _, good = _FINDERS[number]
    each = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda x, b: F.struct(x.alias("x"), b.alias("b")))
    each = F.zip_with(each, F.slice(gaps, 2, F.size(matches)), lambda z, a: F.struct(z["x"].alias("x"), z["b"].alias("b"), a.alias("a")))
    each = F.zip_with(each, starts, lambda z, s: F.struct(z["x"].alias("x"), z["b"].alias("b"), z["a"].alias("a"), s.alias("s")))

    def made(z: Column) -> Column:
        x = z["x"]
        votes = _votes(kind, strict, x, z["b"], z["a"])
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            z["s"].alias("s"),
            (z["s"] + F.length(x)).alias("e"),
            (_is_base(kind, x) if strict else F.lit(False)).alias("base"),
            F.lit(number).alias("finder"),
            _length_class(x).alias("len"),
            *[votes[name].cast("int").alias(name) for name in LABELERS],
        )

    return F.transform(F.filter(each, lambda z: good(z["x"])), made).cast(SPANS)


SPANS = "array<struct<kind:int,s:int,e:int,base:boolean,finder:int,len:int," + ",".join(f"{n}:int" for n in LABELERS) + ">>"


def label(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``candidates``, the voted-on spans of each text. No shuffle."""
    base = without(docs, ["candidates", "n_email", "n_ip", "n_card", "n_phone", "spans"])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cols: dict[str, Column] = {}
    for i, (_, pattern, _, some, _) in enumerate(_FINDERS):
        none = F.array().cast("array<string>")
        cols[f"__m{i}"] = F.when(some(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
    found = base.withColumns(cols)
    found = found.withColumns(
        {
            f"__g{i}": F.when(F.size(f"__m{i}") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>"))
            for i, (_, pattern, *_) in enumerate(_FINDERS)
        }
    )
    # where a match begins: all that lies before it, matches and gaps
    found = found.withColumns(
        {
            f"__l{i}": F.zip_with(F.slice(f"__g{i}", 1, F.size(f"__m{i}")), f"__m{i}", lambda g, m: F.length(g) + F.length(m))
            for i in range(len(_FINDERS))
        }
    )
    found = found.withColumns(
        {
            f"__s{i}": F.zip_with(_before(F.col(f"__l{i}"), lambda a, b: a + b, 0), F.slice(f"__g{i}", 1, F.size(f"__m{i}")), lambda a, g: a + F.length(g))
            for i in range(len(_FINDERS))
        }
    )
    made = found.withColumns(
        {
            f"__s{i}": F.when(
                F.size(f"__m{i}") > 0, _spans(i, F.col(f"__m{i}"), F.col(f"__g{i}"), F.col(f"__s{i}"))
            ).otherwise(F.from_json(F.lit("[]"), SPANS))
            for i in range(len(_FINDERS))
        }
    )
    strict = F.concat(*[F.col(f"__s{i}") for i, f in enumerate(_FINDERS) if f[2]])
    made = made.withColumn("__strict", strict)
    made = made.withColumn("__base", F.filter("__strict", lambda b: b["base"]))
    made = made.withColumn("__loose", F.concat(*[F.col(f"__s{i}") for i, f in enumerate(_FINDERS) if not f[2]]))
    made = _cut_into(made)
    kept = [F.col(f"`{c}`") for c in base.columns if keep_text or c.lower() != text.lower()]
    return made.select(*kept, F.concat("__strict", _not_cut()).alias("candidates"))


def _cut_into(made: DataFrame) -> DataFrame:
    """For each of ``__loose``, in ``__cut``: whether its start, and whether its end, lies within a span of ``__base``.

    All starts of base spans and all places to be looked at are put in one order; how far the base
    spans before a place reach is then a running maximum, so the work isn't spans times spans.
    """
    starts = F.transform("__base", lambda b: F.struct(b["s"].alias("x"), F.lit(1).alias("o"), b["e"].alias("e"), F.lit(-1).alias("i")))

    def ask(x: Column, i: Column) -> Column:
        return F.struct(x.alias("x"), F.lit(0).alias("o"), F.lit(0).alias("e"), i.alias("i"))

    asked = F.flatten(F.transform("__loose", lambda c, i: F.array(ask(c["s"], i * 2), ask(c["e"], i * 2 + 1))))
    none = F.array().cast("array<struct<x:int,o:int,e:int,i:int>>")
    both = (F.size("__loose") > 0) & (F.size("__base") > 0)
    made = made.withColumn("__places", F.when(both, F.array_sort(F.concat(starts, asked))).otherwise(none))
    made = made.withColumn("__reach", F.when(both, _before(F.transform("__places", lambda p: p["e"]), F.greatest, 0)).otherwise(F.array().cast("array<int>")))
    looked = F.zip_with("__places", "__reach", lambda p, m: F.struct(p["i"].alias("i"), (m > p["x"]).alias("cut")))
    return made.withColumn("__cut", F.transform(F.array_sort(F.filter(looked, lambda p: p["i"] >= 0)), lambda p: p["cut"]))


def _not_cut() -> Column:
    """``__loose`` without those that overlap a base span, unless that is part of them."""
    starts, ends = F.filter("__cut", lambda c, i: i % 2 == 0), F.filter("__cut", lambda c, i: i % 2 == 1)
    cut = F.zip_with(starts, ends, lambda a, b: a | b)
    marked = F.zip_with("__loose", cut, lambda c, b: F.struct(c.alias("c"), F.coalesce(b, F.lit(False)).alias("cut")))
    return F.transform(F.filter(marked, lambda z: ~z["cut"]), lambda z: z["c"])


class SpanModel:
    """Reliabilities of the labelers and the weights of the span classifier."""

    def __init__(self, reliability: dict, weights: dict[tuple[str, int, int], float], bias: float) -> None:
        self.reliability, self.weights, self.bias = reliability, weights, bias

    def score(self, c: Column) -> Column:
        """The classifier's log odds of a candidate."""
        out = F.lit(self.bias)
        for (feature, finder, value), w in self.weights.items():
            if not _FINDERS[finder][2] or finder == CARD_FINDER:  # other base finders have base spans only
                out = out + F.when((c["finder"] == finder) & (c[feature] == value), F.lit(w)).otherwise(F.lit(0.0))
        return out


CARD_FINDER = 2


#: Pseudo-counts of a labeler's votes (no, none, yes) on wrong and on right candidates.
_PRIOR = {0: {-1: 2.0, 0: 1.5, 1: 0.5}, 1: {-1: 0.5, 0: 1.5, 1: 2.0}}
FEATURES = ("finder", "len", *LABELERS)


def _expectation_maximisation(patterns: list[tuple[dict[str, int], int]]) -> tuple[list[float], dict]:
    """Posterior of each (votes, count) pattern, and P(vote | class) by finder, labeler and vote. Base spans are right."""
    said = [[(name, p[name]) for name in LABELERS if p[name] != MUTE] for p, _ in patterns]
    post = [1.0 if p["base"] else 1 / (1 + math.exp(-1.2 * sum(v for _, v in each))) for (p, _), each in zip(patterns, said, strict=True)]
    reliability: dict = {}
    for _ in range(ROUNDS):
        prior: dict[int, list[float]] = {}
        tally: dict[tuple[int, str], dict[int, list[float]]] = {}
        for (p, n), each, y in zip(patterns, said, post, strict=True):
            k = prior.setdefault(p["finder"], [1.0, 1.0])
            k[0] += n * (1 - y)
            k[1] += n * y
            for name, v in each:
                t = tally.setdefault((p["finder"], name), {u: [_PRIOR[0][u], _PRIOR[1][u]] for u in (-1, 0, 1)})
                t[v][0] += n * (1 - y)
                t[v][1] += n * y
        reliability = {key: {v: [c / sum(t[u][k] for u in t) for k, c in enumerate(t[v])] for v in t} for key, t in tally.items()}
        for i, ((p, _), each) in enumerate(zip(patterns, said, strict=True)):
            if p["base"]:
                continue
            odds = math.log(prior[p["finder"]][1] / prior[p["finder"]][0])
            for name, v in each:
                no, yes = reliability[p["finder"], name][v]
                odds += math.log(yes / no)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, reliability


def fit(labelled: DataFrame) -> SpanModel:
    """Reliabilities and classifier from all candidates, by way of their patterns' counts."""
    c = labelled.select(F.explode("candidates").alias("c"))
    names = (*FEATURES, "base")
    rows = c.groupBy(*[F.col("c")[n].alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted(((({n: r[n] for n in names}), r["n"]) for r in rows), key=lambda x: sorted(x[0].items()))
    if not patterns:
        return SpanModel({}, {}, -1.0)
    post, reliability = _expectation_maximisation(patterns)
    total = sum(n for _, n in patterns)
    # by finder, so that a vote may mean more for one kind than for another
    features = [[(f, p["finder"], p[f]) for f in FEATURES if p[f] != MUTE or f not in LABELERS] for p, _ in patterns]
    weights: dict[tuple[str, int, int], float] = {f: 0.0 for each in features for f in each}
    squares = dict.fromkeys(weights, 1e-8)
    bias, bias_square = 0.0, 1e-8
    for _ in range(STEPS):  # logistic regression on the posteriors, Adagrad over all patterns
        grad = {k: 1e-3 * w for k, w in weights.items()}
        bias_grad = 0.0
        for each, (_, n), y in zip(features, patterns, post, strict=True):
            z = bias + sum(weights[f] for f in each)
            err = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            bias_grad += err
            for f in each:
                grad[f] += err
        bias_square += bias_grad**2
        bias -= 0.5 * bias_grad / math.sqrt(bias_square)
        for k, g in grad.items():
            squares[k] += g * g
            weights[k] -= 0.5 * g / math.sqrt(squares[k])
    return SpanModel(reliability, weights, bias)


def detect(labelled: DataFrame, model: SpanModel) -> DataFrame:
    """Base counts, and ``spans`` (kind, s, e, base): base spans and those the classifier accepts, by kind and start."""
    accepted = F.filter("candidates", lambda c: c["base"] | (model.score(c) >= 0))
    spans = F.array_sort(
        F.transform(accepted, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base")))
    )

    def count(k: int) -> Column:
        return F.size(F.filter("candidates", lambda c: c["base"] & (c["kind"] == k))).cast("long")

    counts = {f"n_{kind}": count(k) for k, kind in enumerate(BASE)}
    return labelled.withColumns(counts | {"spans": spans}).drop("candidates")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ","
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Each span's text replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    # each span with where those before it end; what begins earlier is part of them
    ends = F.zip_with("__o", _before(F.transform("__o", lambda c: c["e"]), F.greatest, 0), lambda c, m: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), m.alias("m")))
    # the text is cut into long pieces first, then each of them, so that no cut starts from the text's beginning
    some = F.struct(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(found.columns)]
    )  # the caller's columns in one, so that no name can clash
    at = [c.lower() for c in found.columns].index(text.lower())
    rows = found.select(some.alias("row"), order.alias("__o"), F.col(text).alias("__t"))
    rows = rows.withColumn("__e", ends)
    kept = F.filter("__e", lambda c: c["s"] >= c["m"])
    rows = rows.withColumn("__k", kept).withColumn("__last", F.array_max(F.transform("__e", lambda c: c["e"])))
    count = F.ceil(F.size("__k") / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.slice("__k", b * BLOCK + 1, F.lit(BLOCK)))

    def piece(block: Column) -> Column:
        """From the end of what stands before the block to the end of its last gap."""
        first, last = F.element_at(block, 1)["m"], F.element_at(block, -1)["s"]
        cut = F.substring(F.col("__t"), first + 1, last - first)
        return F.struct(block.alias("block"), first.alias("first"), cut.alias("cut"))

    def joined(p: Column) -> Column:
        return F.array_join(
            F.transform(
                p["block"],
                lambda c: F.concat(F.substring(p["cut"], c["m"] - p["first"] + 1, c["s"] - c["m"]), F.element_at(names, c["kind"] + 1)),
            ),
            "",
        )

    tail = F.substring(F.col("__t"), F.col("__last") + 1, F.length("__t"))
    new = F.concat(F.array_join(F.transform(F.transform(blocks, piece), joined), ""), tail)
    rows = rows.withColumn("__new", F.when(F.size("__k") > 0, new).otherwise(F.col("__t")))
    return rows.select(
        *[(F.col("__new") if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(found.columns)]
    )


def find(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Label, fit on all candidates and detect. The labelled rows are written once."""
    labelled = materialise(label(docs, text, keep_text), "pii")
    return detect(labelled, fit(labelled))

"""Personal data: generated candidates, boosted trees, calibrated redaction. DataFrame functions only.

Base spans (email, ip, card, phone) are found by pattern and check. Wide patterns then generate
overlapping candidates with high recall: obfuscated addresses, other separators, numbers without a
plus sign. Each candidate has format and context features, all small integers, and `valid`: its
plain form would pass the check of its kind.

The trees learn which candidates beyond the base spans are real. Positives are base spans rewritten
in the wide forms, each within what stood around it; base-shaped matches that fail the check are
rewritten in the same way as negatives, so that a form does not tell the outcome. Candidates of the
texts that overlap no base span are negatives too, but for those that may well be real: valid
emails and cards, and valid ips and phones that a word before them names. Four fifths of the
documents train, the rest calibrate; for each kind the threshold is the least probability above
which calibration candidates reach PRECISION. The precision holds for forms that are rewritten as
often as they are plain. Added spans are candidates over it that overlap no base span; where added
ones overlap, the best stays.

Training reads counts for each kind and feature vector, whose number is bounded by the features'
ranges, taken over all documents.

Patterns are written with possessive loops and anchored starts: the same matches as the plain forms,
without their quadratic time on long runs. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; repeated rows have the same spans; a table without
candidates of both outcomes adds none; extra columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import fold_of, neutral, read_table, stage, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: A match starts a run, or where the match before it ends.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?+(?:@|\(at\)|\[at\]) ?+[A-Za-z0-9-]++(?:(?: ?+(?:\(dot\)|\[dot\]) ?+|\.)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z])[0-9]++(?:[.,:-][0-9]++){3,}+",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}+[0-9]){11,}+",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?+\(?+[0-9][ ().0-9/-]{5,}[0-9]",
}
#: Named features of a candidate and their largest values.
FEATURES = {"kind": 3, "digits": 20, "size": 12, "spaces": 3, "dots": 4, "hyphens": 3, "brackets": 1, "others": 1, "plus": 1, "at": 1, "before": 4, "after": 4, "named": 1, "valid": 1}
PRECISION = 0.9
#: Characters kept on each side of a rewritten match; the features look at 24 before and one after.
AROUND = 64
_SPAN = "struct<s:int,k:int,e:int>"
_CANDIDATE = f"struct<s:int,k:int,e:int,{','.join(f'{f}:int' for f in FEATURES)}>"

_SEED = "struct<k:int,y:boolean,b:string,m:string,a:string>"


def _count(m: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{chars}]", ""))


def _luhn(m: Column) -> Column:
    d = F.reverse(F.regexp_replace(m, "[^0-9]", ""))
    digit = lambda i: F.substring(d, i, F.lit(1)).try_cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = _count(m, "0-9")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _plain_valid(kind: str, m: Column) -> Column:
    """Whether a candidate passes the check of its kind once its form is undone."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, r" ?(?:@|\(at\)|\[at\]) ?", "@"), r" ?(?:\(dot\)|\[dot\]) ?", ".")
        return plain.rlike(rf"^[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
    if kind == "ip":
        plain = F.translate(m, ",:-", "...")
        return (_count(plain, ".") == 3) & _valid(kind, plain)
    return _valid(kind, F.regexp_replace(m, "^00", "") if kind == "phone" else m)


def _rewritten(kind: Column, m: Column) -> Column:
    """A base-shaped match in one of the wide forms of its kind, chosen by its hash."""
    of = lambda *forms: F.element_at(F.array(*forms), (F.pmod(F.xxhash64(m), F.lit(len(forms))) + 1).cast("int"))
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    dots = lambda d: F.replace(host, F.lit("."), F.lit(d))
    email = of(*(F.concat(local, F.lit(at), h) for at, h in ((" [at] ", dots(" [dot] ")), ("(at)", host), (" @ ", host), (" (at) ", dots(" (dot) ")), ("[at]", dots("[dot]")))))
    digits = F.regexp_replace(m, "[^0-9]", "")
    card = of(*(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{c}") for c in "./_"))
    bare = F.regexp_replace(m, r"^\+", "")
    phone = of(bare, F.concat(F.lit("00"), bare), F.translate(bare, ".-", "//"), digits)
    return F.when(kind == 0, email).when(kind == 1, of(*(F.translate(m, ".", c) for c in ",:-"))).when(kind == 2, card).otherwise(phone)


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]"), 1).when(c.rlike(r"^[\p{L}\p{N}]"), 2).when(c.rlike("^[\"'=:]"), 3).otherwise(4)


def _features(kind: int, m: Column, before: Column, after: Column) -> dict[str, Column]:
    most = lambda c, f: F.least(c, F.lit(FEATURES[f]))
    return {
        "kind": F.lit(kind),
        "digits": most(_count(m, "0-9"), "digits"),
        "size": most((F.length(m) / 4).cast("int"), "size"),
        "spaces": most(_count(m, " "), "spaces"),
        "dots": most(_count(m, "."), "dots"),
        "hyphens": most(_count(m, r"\-"), "hyphens"),
        "brackets": most(_count(m, r"()\[\]"), "brackets"),
        "others": most(_count(m, "_/,:"), "others"),
        "plus": F.startswith(m, F.lit("+")).cast("int"),
        "at": F.contains(m, F.lit("@")).cast("int"),
        "before": _class(F.right(before, F.lit(1))),
        "after": _class(F.left(after, F.lit(1))),
        "named": F.right(before, F.lit(24)).rlike(r"(?i)(tel|phone|call|fax|mobile|mail|card|visa|\bip\b|host|contact)").cast("int"),
        "valid": F.coalesce(_plain_valid(KINDS[kind], m), F.lit(False)).cast("int"),
    }


def _placed(found: str, pieces: str, name: str, to: str, make) -> Column:
    """Matches (and what lies before and after each) folded into spans; make(match, start, before, after) or null."""
    zipped = F.arrays_zip(F.col(found).alias("m"), F.col(pieces).alias("b"), F.slice(F.col(pieces), F.lit(2), F.size(found) + 1).alias("a"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{to}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + F.length(x["b"])
        return F.struct((s + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.concat(state["out"], F.when(x["m"].isNotNull(), F.array(make(x["m"], s, x["b"], F.coalesce(x["a"], F.lit(""))).cast(to))).otherwise(F.array().cast(f"array<{to}>"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda z: z["out"])).otherwise(F.array().cast(f"array<{to}>")).alias(name)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base_` (sorted base spans), `cand_` (candidates with features) and `seeds_` (base-shaped matches, outcome and surroundings)."""
    inner, names = neutral(docs)
    df = inner.withColumn("t_", text_of(names[text]))
    digit, at = F.col("t_").rlike("[0-9]"), F.col("t_").contains("@")
    gates = {"email": at, "ip": digit, "card": digit, "phone": F.col("t_").contains("+") & digit}
    wide_gates = {"email": at | F.col("t_").rlike(r"[(\[]at[)\]]"), "ip": digit, "card": digit, "phone": digit}
    df = df.withColumns({f"g{w}_{k}": c for w, g in ((0, gates), (1, wide_gates)) for k, c in g.items()})
    none = F.array().cast("array<string>")
    columns = {}
    for w, patterns in ((0, PATTERNS), (1, WIDE)):
        for k, p in patterns.items():
            columns[f"f{w}_{k}"] = F.when(F.col(f"g{w}_{k}"), F.regexp_extract_all("t_", F.lit(p), F.lit(0))).otherwise(none)
            columns[f"p{w}_{k}"] = F.when(F.col(f"g{w}_{k}"), F.split("t_", p, -1)).otherwise(none)
    df = df.withColumns(columns)
    out = []
    for i, k in enumerate(KINDS):
        span = lambda m, s, b, a, i=i, k=k: F.struct(F.when(_valid(k, m), s).alias("s"), F.lit(i).alias("k"), (s + F.length(m)).alias("e"))
        out.append(_placed(f"f0_{k}", f"p0_{k}", f"b_{k}", _SPAN, span))
        seed = lambda m, s, b, a, i=i, k=k: F.when(_count(m, "0-9") >= (12 if k == "card" else 0), F.struct(F.lit(i).alias("k"), F.coalesce(_valid(k, m), F.lit(False)).alias("y"), F.right(b, F.lit(AROUND)).alias("b"), m.alias("m"), F.left(a, F.lit(AROUND)).alias("a")))
        out.append(_placed(f"f0_{k}", f"p0_{k}", f"s_{k}", _SEED, seed))
        full = lambda m, s, b, a, i=i: F.struct(s.alias("s"), F.lit(i).alias("k"), (s + F.length(m)).alias("e"), *(c.alias(n) for n, c in _features(i, m, b, a).items()))
        out.append(_placed(f"f1_{k}", f"p1_{k}", f"c_{k}", _CANDIDATE, full))
    df = df.select(*names.values(), *out)
    base = F.sort_array(F.filter(F.concat(*(f"b_{k}" for k in KINDS)), lambda x: x["s"].isNotNull()))
    own = [F.col(n).alias(c) for c, n in names.items() if c not in ("base_", "cand_", "seeds_")]
    return df.select(*own, base.alias("base_"), F.concat(*(f"c_{k}" for k in KINDS)).alias("cand_"), F.filter(F.concat(*(f"s_{k}" for k in KINDS)), lambda x: x.isNotNull()).alias("seeds_"))


class Redactor:
    """The fitted trees, calibration and thresholds of each kind."""

    def __init__(self, model, calibration: dict[int, tuple[float, float]], thresholds: dict[int, float]):
        self.model, self.calibration, self.thresholds = model, calibration, thresholds

    def accepted(self, c: Column) -> Column:
        """Log-odds above the threshold of the candidate's kind, or null."""
        if not self.thresholds:
            return F.lit(None).cast("double")
        margin = boosting.expression(self.model, [c[f] for f in FEATURES])
        out = F.lit(None).cast("double")
        for k, least in self.thresholds.items():
            a, b = self.calibration[k]
            out = F.when((c["k"] == k) & (a * margin + b >= least), a * margin + b).otherwise(out)
        return out


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def outcomes(found: DataFrame) -> DataFrame:
    """(held, c, y): candidates beyond base spans to learn from, of the texts and of rewritten matches."""
    free = F.explode(F.filter("cand_", lambda c: ~F.exists("base_", lambda b: _overlap(b, c)))).alias("c")
    held = (fold_of("doc_id", 5) == 0).alias("held")
    maybe = (F.col("c.valid") == 1) & (F.col("c.k").isin(0, 2) | (F.col("c.named") == 1))
    natural = found.select(held, free).where(~maybe).select("held", "c", F.lit(False).alias("y"))
    seeds = found.select(held, F.explode("seeds_").alias("x")).select("held", "x.*").withColumn("m", _rewritten(F.col("k"), F.col("m")))
    s = F.length("b")
    windows = stage(seeds.select("held", "y", F.struct(s.alias("s"), F.col("k"), (s + F.length("m")).alias("e")).alias("w"), F.concat("b", "m", "a").alias("text")), "pii")
    again = with_spans(windows).select("held", "y", "w", free).where(_overlap(F.col("c"), F.col("w")))
    same = (F.col("c.s") == F.col("w.s")) & (F.col("c.e") == F.col("w.e")) & (F.col("c.k") == F.col("w.k"))
    return natural.union(again.select("held", "c", (F.col("y") & same).alias("y")))


def fit(found: DataFrame) -> Redactor:
    """From doc_id, base_, cand_ and seeds_ of all documents; collects one row for each cell."""
    cells = outcomes(found).groupBy("held", *(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")).orderBy("held", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in cells], dtype=np.int64).reshape(-1, len(FEATURES))
    pos, neg = np.array([r["pos"] for r in cells], float), np.array([r["neg"] for r in cells], float)
    held = np.array([r["held"] for r in cells], bool)
    if not (pos[~held].sum() and neg[~held].sum()):
        return Redactor(None, {}, {})
    model = boosting.fit(x[~held], pos[~held], neg[~held])
    calibration, thresholds = {}, {}
    for k in range(len(KINDS)):
        own = held & (x[:, 0] == k)
        if not pos[own].sum():
            continue
        m = boosting.margins(model, x[own])
        a, b = calibration[k] = boosting.platt(m, pos[own], neg[own])
        score = a * m + b
        order = np.argsort(-score, kind="stable")
        precision = np.cumsum(pos[own][order]) / np.cumsum((pos + neg)[own][order])
        score = score[order]
        last = np.r_[score[1:] != score[:-1], True]
        good = np.flatnonzero(last & (precision >= PRECISION) & (score >= 0))
        if len(good):
            thresholds[k] = float(score[good[-1]]) - 1e-9
    return Redactor(model, calibration, thresholds)


def with_redactions(found: DataFrame, redactor: Redactor) -> DataFrame:
    """found with `spans_`: base spans and accepted candidates, sorted."""
    scored = F.filter(F.transform("cand_", lambda c: F.struct(redactor.accepted(c).alias("v"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))), lambda c: c["v"].isNotNull())
    df = found.withColumn("more_", scored if redactor.thresholds else F.array().cast("array<struct<v:double,s:int,k:int,e:int>>"))
    df = df.withColumn("free_", F.when(F.size("more_") > 0, F.filter("more_", lambda c: ~F.exists("base_", lambda b: _overlap(b, c)))).otherwise(F.col("more_")))
    rank = lambda c: F.struct(c["v"], c["e"] - c["s"], -c["s"], -c["k"])
    best = F.when(F.size("free_") > 0, F.filter("free_", lambda c: ~F.exists("free_", lambda d: _overlap(c, d) & (rank(d) > rank(c))))).otherwise(F.col("free_"))
    df = df.withColumn("spans_", F.sort_array(F.concat("base_", F.transform(best, lambda c: F.struct(c["s"], c["k"], c["e"]).cast(_SPAN)))))
    return df.drop("more_", "free_", "cand_", "seeds_")


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; n_chars follows the text.

    Spans that overlap are replaced together, under the kind of the first.
    """
    inner, names = neutral(docs)
    text_ = names[text]
    redactor = fit(stage(with_spans(inner, text_).select(F.col(names["doc_id"]).alias("doc_id"), "base_", "cand_", "seeds_"), "pii"))
    df = with_redactions(with_spans(inner, text_), redactor)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    mark = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["k"] + 1)), F.lit("]"))

    def step(state: Column, x: Column) -> Column:
        gap = F.concat(state["out"], F.substring(F.col(text_), state["at"] + 1, x["s"] - state["at"]), mark(x))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.when(x["s"] >= state["at"], gap).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("spans_", start, step, lambda z: F.concat(z["out"], F.substring(F.col(text_), z["at"] + 1, F.length(F.col(text_)))))
    df = df.withColumn(text_, F.when(F.size("spans_") > 0, clean).otherwise(F.col(text_)))
    if "n_chars" in names:
        df = df.withColumn(names["n_chars"], F.when(F.size("spans_") > 0, F.length(text_).cast("long")).otherwise(F.col(names["n_chars"])))
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stage(with_spans(docs).drop("text"), "pii")
    df = with_redactions(found, fit(found))
    n = lambda i: F.size(F.filter("base_", lambda x: x["k"] == i)).cast("long")
    return df.select("doc_id", *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(written("base_").cast("binary"), 256).alias("base_sha256"), written("spans_").alias("spans"))

"""Personal data: candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score each candidate from its format and context;
thresholds calibrated for precision on held-out examples select the added redactions. Base spans (email, ip, card,
phone that pass their checks) always stay. Generators, features and trees are DataFrame expressions: the trees are fitted on
the driver over a bounded set of generated examples (`n_train`), then become one CASE expression.

The examples' words around a candidate are those of four languages (en, fr, de, es). A well-formed number is personal data after a word that
names it or after any other word, but not after one that names something else, such as an order. Added spans that overlap a base span are left out; of added
spans that overlap, read from the left, the likelier stays.

Defined results: null and empty texts have no spans; repeated rows are scored each for itself; an empty table gives
an empty result; columns besides id and text are not read, so clashing names do not matter.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .spans import SPAN, Rule, add_spans, fold, joined, redact

LOCAL = "[A-Za-z0-9._%+-]"
DIGIT = lambda t: t.rlike("[0-9]")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.translate(m, " -", "")
    n = F.length(d)

    def add(a, i):
        v = F.ascii(F.substring(d, n - i + 1, F.lit(1))) - 48
        return a + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def ip_parts(m: Column) -> Column:
    def ok(x):
        x = F.ltrim(x, F.lit("0"))
        return (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), ok)


def iban(m: Column) -> Column:
    s = F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))

    def add(a, i):
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def ssn(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$")


RULES = [
    # The same matches as `local+@label(.label)+`; look-behind, \G and possessive loops keep the scan linear.
    Rule("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", guard=lambda t: t.contains("@")),
    Rule("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m, g: ip_parts(m), DIGIT, candidates=True),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m, g: luhn(m), DIGIT),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, g: F.length(digits(m)).between(9, 15), lambda t: t.contains("+"), candidates=True),
    Rule("email_obf", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,}+)++", lambda m, g: m.rlike(r"(?i)[(\[]at[)\]]"), lambda t: t.rlike(r"(?i)[(\[\x20]dot[)\]\x20]"), candidates=True),
    Rule("phone_local", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda m, g: digits(m).rlike("^[2-9][0-9]{2}[2-9]"), DIGIT, candidates=True),
    Rule("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m, g: ssn(m), DIGIT, candidates=True),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", lambda m, g: iban(m), DIGIT, candidates=True),
    Rule("ipv6", r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])", lambda m, g: F.lit(True), lambda t: t.contains(":"), candidates=True),
]
KINDS = [r.kind for r in RULES]
BASE = 4
#: Words that name personal data, and words that name other numbers, in en, fr, de and es.
CUES = r"call|phone|tel|tél|mobile|móvil|portable|fax|contact|reach|mail|write|ssn|social|iban|account|acct|bank|host|addr|from|ip|server|card|pay|visa|client|appel|joindre|courriel|compte|banque|serveur|sécu|anruf|ruf|handy|kontakt|erreich|konto|bankverbindung|schreib|llam|contacto|correo|cuenta|banco|servidor|seguridad"
NOISE = r"version|order|invoice|isbn|item|serial|page|ref|part|sku|build|ticket|section|row|score|model|commande|facture|numéro|article|série|ligne|modèle|bestell|rechnung|artikel|serien|seite|zeile|teil|modell|pedido|factura|artículo|serie|página|fila|modelo|parte"
FEATURES = ["kind", "valid", "cue", "noise", "glued_left", "glued_right", "n_digits", "length", "brackets", "plain"]


def features(c: Column) -> Column:
    """FEATURES of candidate c: its kind and format, and the code points around it."""
    left, right = F.lower(c["l"]), c["r"]
    d = digits(c["m"])
    flags = [
        c["k"], c["ok"].cast("int"), left.rlike(rf"(?U)\b(?:{CUES})").cast("int"), left.rlike(rf"(?U)\b(?:{NOISE})").cast("int"),
        left.rlike(r"[\p{L}0-9_./-]$").cast("int"), right.rlike(r"^[\p{L}0-9_/]|^[.-][0-9]").cast("int"), F.length(d), F.length(c["m"]),
        c["m"].rlike(r"[()\[\]]").cast("int"), (F.size(F.array_distinct(F.split(d, ""))) <= 2).cast("int"),
    ]
    return F.array(*(x.cast("double") for x in flags))


def examples(n: int, seed: int) -> list[dict]:
    """Generated snippets, each with one candidate of an added kind and whether it is personal data."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8)))
    cues = [x for x in CUES.split("|")]
    noise = NOISE.split("|")

    def iban_of(good: bool) -> str:
        body = rng.choice(["DE", "FR", "ES", "GB"])
        rest = num(18)
        check = 98 - int("".join(str(int(x, 36)) for x in rest + body + "00")) % 97
        return f"{body}{check if good else (check + 7) % 90 + 10:02d}{rest}"

    out = []
    for _ in range(n):
        kind = rng.choice(KINDS[BASE:])
        good = rng.random() < 0.5
        # What is no personal data is so for one of three reasons: its form, what it is glued to, or what a word before it says it is.
        why = rng.choices(["form", "glue", "noise"], [0.4, 0.2, 0.4])[0]
        formed = good or why != "form"
        if kind == "email_obf":
            m = f"{word()}{rng.choice(['(at)', ' (at) ', '[at]', ' [at] '])}{word()}{rng.choice(['(dot)', ' (dot) ', '[dot]', ' dot '])}com" if formed else f"{word()} at {word()} dot {word()}"
        elif kind == "phone_local":
            area, mid = (rng.randint(200, 999), rng.randint(200, 999)) if formed else rng.choice([(rng.randint(0, 199), rng.randint(0, 999)), (rng.randint(0, 999), rng.randint(0, 199))])
            m = rng.choice(["({:03d}) {:03d}-{}", "{:03d}-{:03d}-{}", "{:03d} {:03d} {}", "{:03d}.{:03d}.{}"]).format(area, mid, num(4))
        elif kind == "ssn":
            m = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if formed else rng.choice([f"9{num(2)}-{num(2)}-{num(4)}", f"000-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"{num(3)}-{num(2)}-0000"])
        elif kind == "iban":
            m = iban_of(formed)
        else:
            m = ":".join(f"{rng.getrandbits(16):x}" for _ in range(8)) if formed else ":".join(num(2) for _ in range(8))
        before = rng.choice(cues) if good and rng.random() < 0.5 else rng.choice(noise) if not good and why == "noise" else word()
        glued = not good and why == "glue"
        left = f"{word()} {word()} {before}{rng.choice([':', ' is', ' no.', '', ' ' + word()])}{rng.choice([' x/', ' v', '-']) if glued and m[0] not in '(' else ' '}"
        right = rng.choice(["-1", "x", ".7", "/2"]) if glued and (rng.random() < 0.5 or m[0] == "(") else rng.choice(["", " ", ".", ","])
        out.append({"text": f"{left}{m}{right} {word()}.", "kind": KINDS.index(kind), "y": int(good)})
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, ridge: float = 1.0) -> list[tuple]:
    """Depth-2 regression trees on the logistic loss, Newton leaf values. A tree: (feature, cut, left, right) or a value."""
    cuts = [(f, c) for f in range(x.shape[1]) for c in (lambda u: (u[1:] + u[:-1]) / 2)(np.unique(x[:, f]))[:24]]
    sides = np.array([x[:, f] <= c for f, c in cuts]) if cuts else np.zeros((0, len(y)), bool)
    score, trees = np.zeros(len(y)), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = g[rows].sum() / (h[rows].sum() + ridge)
        if not depth or not len(cuts):
            return value
        gl, hl = sides[:, rows] @ g[rows], sides[:, rows] @ h[rows]
        gt, ht = g[rows].sum(), h[rows].sum()
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        i = int(gain.argmax())
        if gain[i] < 1e-6:
            return value
        return (*cuts[i], best(rows[sides[i, rows]], g, h, depth - 1), best(rows[~sides[i, rows]], g, h, depth - 1))

    def apply(tree, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[rows] += rate * tree
            return
        left = x[rows, tree[0]] <= tree[1]
        apply(tree[2], rows[left], out)
        apply(tree[3], rows[~left], out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = best(np.arange(len(y)), y - p, p * (1 - p), 2)
        trees.append(tree)
        apply(tree, np.arange(len(y)), score)
    return trees


def evaluate(trees: list, x: np.ndarray, rate: float) -> np.ndarray:
    def one(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([1 / (1 + np.exp(-rate * sum(one(t, row) for t in trees))) for row in x])


def tree_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.get(x, F.lit(int(tree[0]))) <= float(tree[1]), tree_column(tree[2], x)).otherwise(tree_column(tree[3], x))


def fit(spark: SparkSession, n_train: int = 4000, rounds: int = 24, rate: float = 0.3, precision: float = 0.97, seed: int = 7) -> dict:
    """Fits the trees on one half of the generated examples; the other half sets each kind's threshold: the lowest score
    from which on at least `precision` of the examples are personal data."""
    rows = F.from_json(F.lit(json.dumps(examples(n_train, seed))), "array<struct<text:string,kind:int,y:int>>")
    df = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    df = add_spans(df, "text", RULES)
    cands = F.filter(F.flatten(F.array(*(F.col(f"span_{i}") for i in range(BASE, len(RULES))))), lambda c: c["k"] == F.col("kind"))
    got = df.withColumn("c", F.get(cands, F.lit(0))).where("c is not null").select("kind", "y", features(F.col("c")).alias("x")).collect()
    kind, y, x = np.array([r.kind for r in got]), np.array([r.y for r in got], float), np.array([r.x for r in got])
    half = np.arange(len(y)) % 2 == 0
    trees = boost(x[half], y[half], rounds, rate)
    p, thresholds = evaluate(trees, x[~half], rate), {}
    for k in range(BASE, len(RULES)):
        own = kind[~half] == k
        q, t = p[own], y[~half][own]
        ok = [c for c in sorted(set(np.floor(q * 1e6) / 1e6)) if t[q >= c].mean() >= precision]
        thresholds[k] = max(0.5, ok[0]) if ok else 1.1
    return {"trees": trees, "rate": rate, "thresholds": thresholds}


ITEMS = f"array<struct<s:int,own:int,k:int,e:int,c:{SPAN.removeprefix('array<').removesuffix('>')}>>"


def find(docs: DataFrame, model: dict, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, text_, base (spans of the base kinds) and spans (all chosen), each by start and kind."""
    df = docs.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    df = add_spans(df, "text_", RULES)
    flat = lambda a, b: F.flatten(F.array(*(F.col(f"span_{i}") for i in range(a, b))))
    df = df.withColumn("base", F.array_sort(F.filter(flat(0, BASE), lambda c: c["ok"])))
    df = df.withColumn("cand", flat(BASE, len(RULES)))
    # Candidates that overlap no base span: of those in order, none before ends behind its start, and the next one behind starts behind its end.
    item = lambda c, own: F.struct(c["s"].alias("s"), F.lit(own).alias("own"), c["k"].alias("k"), c["e"].alias("e"), F.when(F.lit(own == 1), c).alias("c"))
    items = F.array_sort(F.concat(F.transform("base", lambda c: item(c, 0)), F.transform("cand", lambda c: item(c, 1))))
    some = F.size("cand") > 0
    df = df.withColumn("items", F.when(some & (F.size("base") > 0), items))
    reach = lambda at, x: (F.when(x["own"] == 0, F.greatest(at, x["e"])).otherwise(at), F.when((x["own"] == 0) | (at <= x["s"]), x))
    df = df.withColumn("items", F.reverse(fold(F.col("items"), F.lit(0), reach, ITEMS)))
    ahead = lambda at, x: (F.when(x["own"] == 0, x["s"]).otherwise(at), F.when((x["own"] == 1) & (at >= x["e"]), x["c"]))
    free = F.reverse(fold(F.col("items"), F.lit(2**31 - 1), ahead, SPAN))
    df = df.withColumn("cand", F.when(~some | (F.size("base") == 0), F.col("cand")).otherwise(free))
    df = df.withColumn("x", F.transform(F.col("cand"), lambda c: F.struct(c.alias("c"), features(c).alias("x"))))
    total = lambda x: 1 / (1 + F.exp(-model["rate"] * sum((tree_column(t, x) for t in model["trees"]), F.lit(0.0))))
    df = df.withColumn("x", F.transform("x", lambda v: F.struct(v["c"]["s"].alias("s"), v["c"]["k"].alias("k"), v["c"]["e"].alias("e"), total(v["x"]).alias("p"))))
    limit = F.array(*(F.lit(float(model["thresholds"].get(k, 2.0))) for k in range(len(RULES))))
    df = df.withColumn("x", F.array_sort(F.filter("x", lambda v: v["p"] >= F.get(limit, v["k"]))))
    # From the left, the likelier of two that overlap stays; of equal ones the first.
    clear = lambda at, v: at["e"] <= v["s"]
    likelier = lambda at, v: (F.when(clear(at, v) | (v["p"] > at["p"]), v).otherwise(at), F.when(clear(at, v) & (at["e"] >= 0), at))
    nobody = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("k"), F.lit(-1).alias("e"), F.lit(-1.0).alias("p"))
    df = df.withColumn("extra", fold(F.col("x"), nobody, likelier, "array<struct<s:int,k:int,e:int,p:double>>", lambda at: F.when(at["e"] >= 0, at)))
    short = lambda c: F.transform(c, lambda v: F.struct(v["s"].alias("s"), v["k"].alias("k"), v["e"].alias("e")))
    df = df.withColumn("all_", F.array_sort(F.concat(short(F.col("base")), short(F.col("extra"))))).withColumn("base", F.array_sort(short(F.col("base"))))
    return df.select(*(F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)), F.col("text_"), "base", F.col("all_").alias("spans"))


def redacted(docs: DataFrame, model: dict, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the text with each found span replaced by its kind in square brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    df = find(docs, model, text, keys)
    return redact(df, "text_", "spans", lambda x: F.get(names, x["k"])).select(*keys, F.col("text_").alias(text))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents"), fit(spark))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return df.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"),
    )

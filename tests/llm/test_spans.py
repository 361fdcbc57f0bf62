"""Spans: many matches in one text, redaction against a plain version, and the added kinds in four languages."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sightline.llm import pii, secrets
from sightline.llm.spans import fold, redact


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def test_fold(spark):
    rows = [(i, list(range(n))) for i, n in enumerate((0, 1, 127, 128, 129, 1000))]
    df = spark.createDataFrame(rows, "i long, a array<int>")
    sums = fold(F.col("a"), F.lit(0), lambda at, x: (at + x, F.when(x % 2 == 0, at + x)), "array<int>", lambda at: at)
    got = {r.i: r.s for r in df.select("i", sums.alias("s")).collect()}
    for i, a in rows:
        assert got[i] == [sum(a[: k + 1]) for k in a if k % 2 == 0] + ([sum(a)] if a else [])


def test_many_matches(spark, model):
    """100,000 matches in one text, of kinds that overlap and kinds that do not."""
    rng = random.Random(1)
    some = ["a.b@c.de", "+1 (523) 555-1055", "10.0.0.1", "(555) 234-5678", "123-45-6789", "4111111111111111", "jane(at)site(dot)com"]
    text = " é; ".join(rng.choice(some) for _ in range(100_000))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    began = time.time()
    r = pii.find(df, model).first()
    assert time.time() - began < 120
    assert len(r.base) > 50_000 and len(r.spans) > len(r.base)
    assert all(a.s < b.s for a, b in zip(r.base, r.base[1:])) and [text[x.s : x.e] for x in r.base[:50]] == [m[0] for m in re.finditer(r"a\.b@c\.de|\+1 \(523\) 555-1055|10\.0\.0\.1|4111111111111111", text)][:50]
    keys = "é ".join(f"token={i:032x}" for i in range(50_000))
    began = time.time()
    out = secrets.redacted(spark.createDataFrame([(0, keys)], "doc_id long, text string")).first().text
    assert time.time() - began < 120 and out == "é ".join(["[SECRET]"] * 50_000)


def test_redact(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        text = "".join(rng.choice("aé\n😀") for _ in range(rng.choice([0, 5, 1023, 1024, 1025, 5000])))
        spans = sorted((a, 0, min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(max(1, len(text))) for _ in range(rng.randint(0, 40))) if a < len(text))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i long, t string, x array<struct<s:int,k:int,e:int>>")
    got = {r.i: r.t for r in redact(df, "t", "x", lambda x: F.lit("#")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for a, _, e in spans:
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, e)
        assert got[i] == out + text[at:]


def test_uncapped(spark, model):
    long = "x" * 300
    texts = [f"see https://{long}:{long}@host.example/ now", f"-----BEGIN {'A' * 20} B C D E PRIVATE KEY-----", f"write {long}(at){long}(dot)a" + "b" * 40 + "(dot)cd(dot)ef(dot)gh(dot)ij ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.path: [secrets.KINDS[x.k] for x in r.spans] for r in secrets.scan(df, path="doc_id").collect()}
    assert got[0] == ["url_login"] and got[1] == ["private_key"]
    assert [(x.k, x.s) for x in pii.find(df.where("doc_id = 2"), model).first().spans] == [(pii.KINDS.index("email_obf"), 6)]


#: Sentences of four languages with a place for a number; words that name personal data, words that name something else.
FRAMES = {
    "en": (["please call {} after six", "my ssn is {} ok", "we saw them walk there, {} and then home", "iban: {} please"], ["order no. {} was sent", "see invoice {} for that", "ticket {} is closed"]),
    "fr": (["appelez le {} demain", "notre compte {} est ouvert", "il arrive ce soir, {} puis il part", "mon portable : {} merci"], ["la commande {} est partie", "voir facture {} du mois", "article {} en stock"]),
    "de": (["meine handynummer {} gilt noch", "das konto {} bleibt", "wir gehen heute hin, {} und dann heim", "kontakt: {} bitte"], ["die bestellung {} ist da", "siehe rechnung {} vom mai", "artikel {} ist aus"]),
    "es": (["llame al {} por favor", "mi cuenta {} sigue abierta", "vienen esta noche, {} y luego se van", "correo o tel {} gracias"], ["el pedido {} ya llega", "ver factura {} de mayo", "modelo {} en venta"]),
}


def numbers(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    body = d(18)
    check = 98 - int(body + "131400") % 97
    return {"phone_local": f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{d(4)}", "ssn": f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "iban": f"DE{check:02d}{body}", "email_obf": f"ana{d(2)}(at)casa(dot)org"}


def test_added_kinds_by_language(spark, model, capsys):
    rng = random.Random(5)
    rows, want = [], {}
    for lang, (good, bad) in FRAMES.items():
        for frames, y in ((good, True), (bad, False)):
            for f in frames * 25:
                for kind, m in numbers(rng).items():
                    if not y and kind == "email_obf":
                        continue
                    want[len(rows)] = (lang, kind, y)
                    rows.append((len(rows), f.format(m)))
    got = {r.doc_id: bool(len(r.spans)) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for lang in FRAMES:
        own = [(got[i], y) for i, (x, _, y) in want.items() if x == lang]
        hit = sum(g and y for g, y in own)
        recall, precision = hit / sum(y for _, y in own), hit / max(1, sum(g for g, _ in own))
        with capsys.disabled():
            print(f"{lang}: recall {recall:.3f}, precision {precision:.3f}")
        assert recall >= 0.9 and precision >= 0.9


def test_uncued_phones(spark, model):
    text = " und dann ".join(f"(555) 234-{i:04d}" for i in range(6000))
    r = pii.find(spark.createDataFrame([(0, text)], "doc_id long, text string"), model).first()
    assert len(r.spans) > 5900

import random

import numpy as np

from treeline.llm import reading as R
from treeline.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, source string, lang string, x string, reading_band string"
VOCAB = {
    1: ("the a it we you do not is see keep old new".split(), "map tree node list file box".split(), 7),
    2: ("each another may every while until that will".split(), "layout single filter narrow report garden".split(), 14),
    3: ("whereas although consistent under will cannot".split(), "governance evaluation practical dependency architecture".split(), 24),
    4: ("notwithstanding irrespective albeit concerning".split(), "epistemological heteroscedasticity compositionality phenomenological interoperability".split(), 38),
}


def text(band, seed, sentences=12):
    r = random.Random(seed)
    common, rare, size = VOCAB[band]
    return " ".join(" ".join(r.choice(common + rare + ["the", "of", "and", "to"]) for _ in range(max(4, int(r.gauss(size, 2))))).capitalize() + "." for _ in range(sentences))


def test_describe_only_english_prose():
    assert R.describe(text(1, 1)) is not None and len(R.describe(text(1, 1))) == len(R.FEATURES)
    assert R.describe(None) is None and R.describe("") is None and R.describe("LGTM") is None
    assert R.describe("2024-01-01T00:00:00Z INFO started job 17\n" * 50) is None
    assert R.describe("path;size;lines\n" + "a/b.go;17;23\n" * 80) is None
    assert R.describe("Wenn der Ordner leer ist, bleibt die Kennzahl im Verzeichnis ohne Wert. " * 20) is None
    code = "```\n" + text(2, 3) + "\n```\nShort note here."
    assert R.describe(code) is None
    assert R.describe("".join(f"- {s}.\n" for s in text(2, 4).split(".") if s)) is not None
    long = R.describe(text(2, 5, 8000))
    assert np.isfinite(long).all()


def test_boost_fits_and_depth_predict_agree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1] + 0.1 * rng.normal(size=3000)
    model = R.boost(x[:2000], y[:2000])
    error = ((model.predict(x[2000:]) - y[2000:]) ** 2).mean()
    assert error < 0.1 * y.var()
    one = R.boost(x[:50], np.ones(50))
    assert np.allclose(one.predict(x[:10]), 1.0)


def test_calibrate_cuts():
    y = np.repeat([1.0, 2.0, 3.0, 4.0], 100)
    p = y * 0.5 + 1 + np.random.default_rng(1).normal(0, 0.02, 400)
    cuts = R.calibrate(p, y)
    assert ((1 + np.searchsorted(cuts, p, side="right")) == y).mean() > 0.99


def test_bands_held_out(spark):
    rows, labels, truth = [], [], {}
    for d in range(700):
        band = 1 + d % 4
        truth[d] = band
        rows.append((d, text(band, d), f"s{d % 9}" if d % 11 else None, None, "a", "b"))
        if d < 500:
            for k in range(d % 3):
                wrong = random.Random(d * 7 + k).random() < 0.08
                labels.append((d, f"r{k}", min(4, max(1, band + (1 if wrong else 0))), "z"))
    rows += [(800, None, "s1", "en", "", ""), (801, "", "s1", "en", "", ""), (None, rows[0][1], "s1", "en", "", ""), (0, rows[0][1], "s1", "en", "", "")]
    labels += [(0, "r9", None, "z"), (None, "r9", 2, "z"), (999, "r1", 2, "z"), (1, "r1", 9, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    got = R.reading_bands(docs, spark.createDataFrame(labels, "doc_id bigint, rater string, reading_band int, text string")).collect()
    assert len(got) == 701
    held = [(x.doc_id, x.reading_band) for x in got if x.doc_id >= 500]
    assert np.mean([truth[d] == b for d, b in held]) > 0.97
    none = spark.createDataFrame([], "doc_id bigint, rater string, reading_band int")
    assert R.reading_bands(docs, none).count() == 0
    assert R.reading_bands(docs.limit(0), none).count() == 0


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    """Bands given to documents agree with what their raters said (who err by one band now and then)."""
    labels = spark.read.parquet(f"{sf_dir}/reading_labels.parquet").where("reading_band is not null").toPandas()
    band = {r.doc_id: r.reading_band for r in QUERIES["p9_found"](spark, sf_dir).collect()}
    assert set(labels["doc_id"]) <= set(band)
    assert np.mean([band[d] == b for d, b in zip(labels["doc_id"], labels["reading_band"])]) > 0.85

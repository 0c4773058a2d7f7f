import pytest

from cloudloom.llm import langid as L

DOCS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return L.sample_labelled(spark.read.parquet(f"{DOCS}/documents.parquet"), 1000)


def test_held_out_accuracy(labelled):
    model = L.train(labelled[::2])
    rest = [(lang, s) for lang, s in labelled[1::2]]
    right = sum(model.decode(L.plain_words(s))[0] == lang for lang, s in rest) / len(rest)
    assert right > 0.85  # a part of the labels is wrong on purpose
    clean = [("fr", "L'ancien cahier se lit comme leur resultat et rien d'autre"), ("pl", "Stary zeszyt pokazuje ze wykres ponizej i nic wiecej"), ("de", "Das alte Notizbuch erklärt der Farbkanal ohne Verlust"), ("es", "La segunda cámara muestra la distancia media y nada más")]
    assert [model.decode(L.plain_words(t))[0] for _, t in clean] == [lang for lang, _ in clean]


def test_labels_in_any_spelling():
    assert [L.label_code(x) for x in ("EN", "en-GB", "eng", "English", None, " ", "n/a", "und", "Deutsch", "pt_BR", "zxx")] == ["en", "en", "en", "en", "", "", "", "", "de", "pt", "zxx"]


def test_cells_and_prose():
    t = "# %% [markdown]\n# Head\n\nSome `code` here $x^2$ and [a](http://x) https://y.z word\n\n# %% [code] n=1\nx = 1\n# %% [markdown]\nlast"
    cells = list(L.markdown_cells(t))
    assert [c for c, _ in cells] == [0, 2]
    text = " ".join(L.segments(cells[0][1]))
    assert "code" not in text and "x^2" not in text and "http" not in text and "word" in text


def test_reasons_and_edges(spark):
    base = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text", "lang")
    en = "The old notebook shows the opacity of each blob and nothing else in a few seconds"
    de = "Das alte Notizbuch zeigt die Deckkraft der Flecken ohne Verlust in wenigen Sekunden"
    extra = [(-1, f"# %% [markdown]\n{en}", "English"), (-2, f"# %% [markdown]\n{en}", "de"), (-3, f"# %% [markdown]\n{en}\n\n{de}", "en"), (-4, f"# %% [markdown]\n{de}", None), (-5, None, "en"), (-6, "", "en"), (-7, "# %% [code] n=1\nx", None), (-8, "# %% [markdown]\n", None)]
    got = L.label_check(base.unionByName(spark.createDataFrame(extra, base.schema))).where("doc_id < 0").collect()
    assert {(r.doc_id, r.reason) for r in got} == {(-1, "right"), (-2, "wrong"), (-3, "mixed"), (-4, "missing")}
    assert {(r.doc_id, r.lang) for r in got} == {(-1, "en"), (-2, "en"), (-3, "en"), (-3, "de"), (-4, "de")}
    assert all(0 < r.confidence <= 1 for r in got)


def test_codewords_are_apart():
    m = L.code_matrix(8, 31)
    assert min((m[a] != m[b]).sum() for a in range(8) for b in range(a)) >= 12


def test_every_segment_comes_out_and_few_words_do_not_count(spark):
    base = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text", "lang")
    en = "The old notebook shows the opacity of each blob and nothing else in a few seconds"
    extra = [(-1, f"# %% [markdown]\n{en}\n\nDas alte Notizbuch zeigt die Deckkraft\n\n{en}", "fr"), (-2, "# %% [markdown]\nDas alte Notizbuch zeigt die Deckkraft\n\nohne Verlust in wenigen Sekunden hier", None)]
    checked = L.label_check(base.unionByName(spark.createDataFrame(extra, base.schema))).where("doc_id < 0")
    got = {(r.doc_id, r.segment): r for r in checked.collect()}
    assert [k for k in sorted(got) if k[0] == -1] == [(-1, 0), (-1, 1), (-1, 2)]
    assert [got[-1, i].counts for i in range(3)] == [True, False, True] and got[-1, 1].reason == "wrong"
    assert [k for k in sorted(got) if k[0] == -2] == [(-2, -1), (-2, 0), (-2, 1)]
    assert {(r.doc_id, r.lang) for r in L.flagged(checked).collect()} == {(-1, "en"), (-2, got[-2, -1].lang)}
    assert all(r.ambiguous for r in got.values() if r.confidence < 0.5)

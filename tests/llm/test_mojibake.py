from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tracelode.llm import mojibake as M

CLEAN = [
    "Größe später ausführen Straße", "déjà vérifié même réponse, où?", "сборки файл теперь очередь", "σφάλματος προσθήκη", "画面の表示 設定を修正", "część łącze użycie", "PADRÃO NÃO Âge ÂÊÎ ÄÖÜ ½ ¼ °C ±3 m²",
    "╔══╗ ║ok║ ├── √n ∞ → ✓ « oui » ‹non› „ja“ it’s", "plain \\u00e9 &eacute; =C3=A9 Ã", "مرحبا שלום สวัสดี 안녕", "👩‍🔧 👍🏽 ‮abc", "",
]
GARBLED = {
    "Größe später": [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman")],
    "теперь очередь": [("utf-8", "cp1252"), ("koi8-r", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("utf-8", "cp866")],
    "画面の表示": [("utf-8", "latin-1"), ("shift_jis", "cp437")],
    "część łącze": [("cp1250", "cp1252"), ("utf-8", "cp1250")],
    "it’s „ja“": [("utf-8", "cp1252")],
}


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token", F.lit("clash")).withColumn("n_docs", F.lit(1))
    return docs, {r.doc_id for r in M.garbled_documents(spark, docs).select("doc_id").distinct().collect()}


def test_clean_texts_are_left_alone_and_garbled_ones_found(spark):
    texts = CLEAN * 5 + [None]
    base = len(texts)
    for original, chains in GARBLED.items():
        for source, read in chains:
            texts.append("x " + M._read(original.encode(source), read) + " y")
    texts.append(M._read(M._read("Größe".encode(), "cp1252").encode(), "cp1252"))
    texts += ["Gr��e", "Zo\u0083", "Name: " + M._read("Tör Völundr".encode(), "cp1252")]
    _, found = run(spark, texts)
    assert found == set(range(base, len(texts)))


def test_restoration(spark):
    texts = CLEAN * 4 + [M._read("später déjà".encode(), "cp1252"), M._read("теперь файл".encode("koi8-r"), "latin-1"), "long " * 50_000 + M._read("Straße".encode(), "mac_roman")]
    docs, _ = run(spark, texts)
    got = {r.doc_id: r for r in M.restored_documents(spark, docs).collect()}
    n = len(texts)
    assert got[n - 2].restored == "теперь файл" and got[n - 1].restored.endswith(" Straße") and got[n - 3].restored.startswith("später")


@pytest.mark.parametrize("codec", M.READ_AS)
def test_reversals_undo_one_reading(codec):
    for word in ("Größe", "очередь", "画面"):
        assert word in M.reversals(M._read(word.encode(), codec))


def test_nothing_to_find(spark):
    _, found = run(spark, ["ascii only", None, ""])
    assert found == set()
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.restored_documents(spark, docs).count() == 0


def test_many_copies_of_a_garbled_text_are_found(spark):
    koi8 = "x " + M._read("сборки файл теперь очередь".encode("koi8-r"), "cp1251") + " y"
    texts = CLEAN * 2 + [f"{CLEAN[2]} again"] + [koi8] * 40
    docs, found = run(spark, texts)
    assert found == set(range(len(texts) - 40, len(texts)))
    assert {r.restored for r in M.restored_documents(spark, docs).collect()} == {"x сборки файл теперь очередь y"}


def test_usual_garbled_tokens_are_found_where_a_text_agrees(spark):
    variants = [f"change {i} " + M._read("Größe später ausführen".encode("cp1252"), "cp437") for i in range(30)]
    variants += [f"change {i} " + M._read("сборки файл теперь".encode("koi8-r"), "cp1251") for i in range(30)]
    texts = CLEAN + variants
    _, found = run(spark, texts)
    assert found == set(range(len(CLEAN), len(texts)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_share_of_texts_restored(spark):
    """Clean commits read wrongly as a whole: all are found; how many are restored to the letter depends on the words known (1,000 documents here)."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    garbled = {r.doc_id for r in M.garbled_documents(spark, documents).collect()}
    clean = [r for r in documents.where(F.octet_length("text") != F.char_length("text")).orderBy("doc_id").collect() if r.doc_id not in garbled][:45]
    once = lambda text, codec: M._read(text.encode(), codec)
    wrong = (lambda t: once(t, "latin-1"), lambda t: once(t, "cp1252"), lambda t: once(once(t, "cp1252"), "cp1252"))
    made = [(10_000_000 + k, wrong[k % 3](r.text), r.text) for k, r in enumerate(clean)]
    both = documents.unionByName(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"))
    got = {r.doc_id: r.restored for r in M.restored_documents(spark, both).where("doc_id >= 10000000").collect()}
    assert len(clean) == 45 and set(got) == {m[0] for m in made}
    assert sum(got[k] == text for k, _, text in made) >= 0.7 * len(made)

"""The language stage drops texts in no learned language, also in a learned script."""

import random

import corpus_pipeline

ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura"
DUTCH = "Het is vandaag mooi weer en wij gaan met de fiets naar het strand omdat de kinderen graag in het water spelen en daarna eten we samen een ijsje op het plein"


def test_unlearned_latin_text_goes_and_others_stay(spark):
    r = random.Random(3)
    noise = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(60))
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, ITALIAN, None), (-2, DUTCH, None), (-3, noise, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in corpus_pipeline.known_language(spark, own.unionByName(odd), "").select("doc_id").collect()}
    assert got == {r["doc_id"] for r in own.select("doc_id").collect()}

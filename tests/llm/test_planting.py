import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cloudweave.llm import planting, secret_scan


def test_planted_findings_stand_where_they_say(spark, odd, empty):
    table = secret_scan._rows(odd)
    rows = planting.planted(table, least=30).collect()
    held = table.where("text != ''").select("row_key").distinct().count()
    rounds = -(-30 // held)
    assert len(rows) == held * rounds * len(planting.KINDS) and {r.kind for r in rows} == set(planting.KINDS)
    assert all(0 <= r.start and r.start + r.length <= len(r.text) for r in rows)
    key = next(r for r in rows if r.kind == "cloud key")
    assert key.label == 1.0 and key.text[key.start : key.start + key.length][:4] in ("AKIA", "ASIA")
    assert sorted(map(str, rows)) == sorted(map(str, planting.planted(table.repartition(1), least=30).collect()))
    assert planting.planted(secret_scan._rows(empty)).count() == planting.planted(table.where("text = ''")).count() == 0


def test_forest_beats_the_rule_on_documents_it_has_not_seen(documents):
    """Of findings planted in one document of four, precision and recall of a forest fitted on the others."""
    table = secret_scan._rows(documents)
    statistics = secret_scan.corpus_statistics(table.select("text"))
    held = F.pmod("row_key", F.lit(4)) == 0
    model = secret_scan.fit(secret_scan.planted_findings(table.where(~held), statistics).drop("kind"))
    found = secret_scan.planted_findings(table.where(held), statistics)
    scored = model.transform(VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(found))
    scored = scored.select("label", (vector_to_array("probability")[1] >= 0.5).alias("won"), (F.col("named") * F.col("assigned") == 1).alias("rule"))
    rows = scored.collect()
    right = sum(r.won and r.label == 1 for r in rows)
    assert right >= 0.95 * sum(r.label == 1 for r in rows) and right >= 0.95 * sum(r.won for r in rows)
    assert sum(r.rule == (r.label == 1) for r in rows) < 0.6 * len(rows)


def test_named_look_alikes_lose_and_keys_without_names_win(spark, documents):
    """Values that no kind of planting makes, in texts of the corpus; every second stands in a row of its own source."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = {
        1: [lambda: f'token = "{r.getrandbits(160):040x}"', lambda: "pat_" + "".join(r.choices(letters, k=34)), lambda: 'secret: "' + "".join(r.choices(letters + "_-", k=28)) + '"'],
        0: [lambda: 'token = "' + r.choice("3579acf") * 40 + '"', lambda: 'secret: "' + "98765" * 6 + '"', lambda: f"tree {r.getrandbits(160):040x}", lambda: "password = changethis"],
    }
    rows, truth = [], {}
    for label, kinds in make.items():
        for made in kinds:
            for _ in range(20):
                lead = "several words of some plain text "
                truth[100_000 + len(rows)] = label
                rows.append((100_000 + len(rows), lead + made() + " and what follows it", "src1"))
    docs = documents.select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    won = {x.doc_id for x in secret_scan.scan(docs).where("is_secret").select("doc_id").distinct().collect()}
    right = [(d in won) == bool(y) for d, y in truth.items()]
    assert sum(right) >= 0.95 * len(right)
    named = {r.doc_id for r in documents.where("text like '%token = \"%'").select("doc_id").collect()}
    assert {d for d in won if d < 100_000} == named

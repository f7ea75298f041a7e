import re

from plumeline.llm import licenses

APACHE, MIT = licenses.NOTICES["Apache-2.0"], licenses.NOTICES["MIT"]
GRANT = licenses.NOTICES["MIT-grant"]
TEXTS = [None, "", "a license", "x y " + APACHE.upper() + " z", MIT + "\n" + APACHE, "w " * 500 + MIT, GRANT.replace("obtaining", "who gets"), GRANT + " and more", "licensed under the apache", APACHE.replace("2.0", "9.9"), "é license ß " + MIT + " ü"]


def brute(text):
    own = re.findall(r"[^\W_]+", (text or "").lower())
    out = {}
    for name, template in licenses.NOTICES.items():
        wanted, scale = set(licenses.template_shingles(template)), licenses.scales(licenses.NOTICES, 0.8, 0.999)[name]
        best = 0.0
        for i in range(len(own)):
            w = own[i : i + scale.words]
            best = max(best, len(wanted & {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}) / len(wanted))
        if best >= 0.8:
            out[name] = best
    return out


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "no") for i, t in enumerate(TEXTS)], "doc_id long, text string, license_id string")
    found = {}
    for r in licenses.scan(docs.drop("license_id")).collect():
        found.setdefault(r.doc_id, {})[r.license_id] = r.containment
    assert found == {i: b for i, t in enumerate(TEXTS) if (b := brute(t))}
    assert licenses.scan(docs.limit(0)).isEmpty()


def test_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, APACHE)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_match_has_a_required_word():
    required = set(licenses.required_words(licenses.NOTICES, 0.8))
    for template in licenses.NOTICES.values():
        shingles = licenses.template_shingles(template)
        assert sum(not required & set(s.split()) for s in shingles) < 0.8 * len(shingles)


def test_bands_are_enough():
    for s in licenses.scales(licenses.NOTICES, 0.8, 0.999).values():
        common = -(-4 * s.least // 5)
        jaccard = common / (s.words - 4 + s.least - common)
        assert 1 - (1 - jaccard) ** s.bands >= 0.999


def test_templates_of_a_table(spark):
    """Full texts from a table, of very different lengths, with ids that repeat and null rows; the plan has no Python in it."""
    long = " ".join(f"clause{i} grants{i % 7} you{i % 11} rights{i}" for i in range(900))
    rows = [*licenses.NOTICES.items(), ("FULL", long), ("FULL", long + " more"), (None, "x"), ("none", None)]
    table = spark.createDataFrame(rows, "license_id string, text string")
    texts = [*TEXTS, "before " + long + " after", " ".join(long.split()[:1000]), "w " * 30_000 + long]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, MIT), (0, MIT)], "doc_id long, text string")
    found = licenses.scan(docs, table)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    want = {i: set(b) for i, t in enumerate(TEXTS) if (b := brute(t))}
    n = len(TEXTS)
    assert got == want | {n: {"FULL"}, n + 2: {"FULL"}, None: {"MIT"}, 0: {"MIT"}}
    assert licenses.scan(docs, table.limit(0)).isEmpty()

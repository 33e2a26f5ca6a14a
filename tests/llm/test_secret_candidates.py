"""Rare classes and candidates of the secret scan."""

import random

from matrel.llm import secrets


def table(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def scanned(spark, texts):
    docs = table(spark, texts)
    found = secrets.features(secrets.findings(docs), secrets.dictionary(docs))
    return found


def test_rare_secrets_are_in_the_sample(spark):
    rng = random.Random(2)
    number = lambda: "".join(rng.choices("0123456789", k=18))
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    keys = {i * 100 for i in range(4)}
    found = scanned(spark, [f'the token = "{key()}" of it' if i in keys else f"the number {number()} of it" for i in range(400)])
    model = secrets.train_forest(secrets.label_findings(found), bound=20)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in secrets.score_findings(found, model).collect()}
    assert {i for i, secret in got.items() if secret} == keys and len(got) == 400


def test_one_class_alone_decides_by_own_labels(spark):
    found = scanned(spark, ['token = "04debebab91ab85687d33eeaaf9ac699e1188f962" set', "number 4785380592391139 set"])
    for label in (0.0, 1.0):
        model = secrets.train_forest(secrets.label_findings(found).filter(f"label = {label}"))
        assert {r["doc_id"]: r["score"] for r in secrets.score_findings(found, model).collect()} == {0: 1.0, 1: 0.0}


def test_values_and_key_blocks_are_candidates(spark):
    block = "-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQ\nabcdefgh\n-----END RSA PRIVATE KEY-----"
    texts = {'my password = "h!ke$9" here': ("h!ke$9", 4), "pwd: s3c.ret~x#1, then": ("s3c.ret~x#1", 2),
             "{'api_key': 'QwErTyUiOpAsDfGhJk'}": ("QwErTyUiOpAsDfGhJk", 2), 'secret="two words here" end': ("two words here", 1),
             f"see\n{block}\nend": (block, 2), "no value here at all": None}
    rows = secrets.findings(table(spark, list(texts))).collect()
    assert {(r["doc_id"], r["secret"], r["place"]) for r in rows} == {(i, *w) for i, w in enumerate(texts.values()) if w}
    assert len(rows) == 5
    gone = secrets.redact(table(spark, list(texts) + ["number 4785380592391139 set"] * 5)).filter("doc_id IN (0, 2, 3, 4)").collect()
    assert all(secrets.MARK in r["text"] and list(texts.values())[r["doc_id"]][0] not in r["text"] for r in gone) and len(gone) == 4


def test_quoted_password_with_a_sign_is_labelled_a_secret(spark):
    found = scanned(spark, ['password = "p@ss!w9" set', 'password = "jo@mail.example.org" set'])
    assert {r["doc_id"]: r["label"] for r in secrets.label_findings(found).collect()} == {0: 1.0, 1: 0.0}


def test_long_values_and_blocks_are_found_whole(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))
    quoted, bare = letters(600), letters(5000) + "!" + letters(300)
    block = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(letters(31) + "-" + letters(31) for _ in range(1600)) + "\n-----END PRIVATE KEY-----"
    assert len(block) > 100_000
    texts = [f'password = "{quoted}" end', f"see token={bare} end", f"a b\n{block}\nend", "-----BEGIN PRIVATE KEY-----\n" + "x-" * 20_000,
             " ".join(f"pwd{i}=abc{i}def" for i in range(3000)), "  token = secret-one\n\n passwd: secret-two "]
    rows = {(r["doc_id"], r["secret"], r["place"]) for r in secrets.findings(table(spark, texts)).collect()}
    assert {(0, quoted, 3), (1, bare, 2), (2, block, 3), (5, "secret-one", 4), (5, "secret-two", 6)} <= rows
    assert {(4, f"abc{i}def", i + 1) for i in range(3000)} <= rows
    assert not {r for r in rows if r[0] == 3 and r[1].startswith("-----BEGIN")}

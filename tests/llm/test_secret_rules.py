"""The added rules take matches of any length."""

import re

import pytest
from pyspark.sql import functions as F

from docspark.llm import secret_scan

LONG = {
    "private_key": (["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN " + "VERY " * 5000 + "LONG PRIVATE KEY-----"], ["-----BEGIN rsa PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----", "-----BEGIN PRIVATE KEY"]),
    "url_password": (["ftp://u:abc@h", "https://" + "u" * 100 + ":" + "p" * 5000 + "@host"], ["http://h:80/a@b", "x://u:ab@h", "http://u v:abc@h"]),
}


@pytest.mark.parametrize("kind", LONG)
def test_long_matches(spark, kind):
    rule = next(r for r in secret_scan.RULES if r.kind == kind)
    good, bad = LONG[kind]
    df = spark.createDataFrame(list(enumerate(good + bad)), "id int, t string").select("id", F.regexp_extract("t", rule.pattern, 0).alias("hit"))
    got = {r["id"]: r["hit"] for r in df.collect()}
    assert all(got[k] and re.search(rule.pattern, t)[0] == got[k] for k, t in enumerate(good)) and not any(got[len(good) + k] for k in range(len(bad)))

"""Values of encrypted files: each is JSON, encrypted by AES in GCM mode with its file's key; absent values stay absent. Spark's
own functions do it, so that reads stay native and prune columns; filters on values aren't pushed to the files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypted(value: Column, key: str, options: dict[str, str]) -> Column:
    return F.when(value.isNotNull(), F.aes_encrypt(F.to_json(F.struct(value.alias("v")), options), F.unhex(F.lit(key)), F.lit("GCM")))


def decrypted(value: Column, key: str, kind: str, options: dict[str, str]) -> Column:
    return F.from_json(F.aes_decrypt(value, F.unhex(F.lit(key)), F.lit("GCM")).cast("string"), f"v {kind}", options)["v"]

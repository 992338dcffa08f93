"""Made-up people with valid check digits, the same from run to run, in any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.checksums import credit_check_char, id_check_char

FAMILY, GIVEN = "王李张刘陈杨赵黄周吴", "伟芳娜敏静强磊洋艳杰"


def _pick(signs: str, n: Column) -> Column:
    return F.substring(F.lit(signs), F.pmod(n, F.lit(len(signs))).cast("int") + 1, F.lit(1))


def _digits(key: Column, salt: int, n: int) -> Column:
    """n digits that follow from the key."""
    return F.lpad(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")


def phone(key: Column) -> Column:
    return F.concat(F.lit("1"), _pick("3456789", F.xxhash64(key, F.lit(1))), _digits(key, 2, 9))


def id_number(key: Column) -> Column:
    born = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(18000)).cast("int")), "yyyyMMdd")
    body = F.concat(F.lit("110105"), born, _digits(key, 4, 3))
    return F.concat(body, id_check_char(body))


def credit_code(key: Column) -> Column:
    body = F.concat(F.lit("91310000MA"), _digits(key, 5, 7))
    return F.concat(body, credit_check_char(body))


def bank_card(key: Column) -> Column:
    return F.concat(F.lit("6222"), _digits(key, 6, 15))


def name(key: Column) -> Column:
    return F.concat(_pick(FAMILY, key), _pick(GIVEN, F.xxhash64(key, F.lit(7))))


def people(spark: SparkSession, n: int) -> DataFrame:
    key = F.col("id")
    return spark.range(n).select("id", name(key).alias("name"), phone(key).alias("phone"), id_number(key).alias("id_number"), bank_card(key).alias("bank_card"), credit_code(key).alias("credit_code"))


def people_json(spark: SparkSession, n: int) -> DataFrame:
    """doc_id, json: a person to a document, with a remark that holds two numbers."""
    p = people(spark, n)
    remark = F.concat(F.lit("短信 "), "phone", F.lit(" 已发 "), phone(F.col("id") + n))
    return p.select(F.col("id").alias("doc_id"), F.to_json(F.struct(F.col("name").alias("姓名"), F.col("phone").alias("手机号"), F.col("id_number").alias("身份证号"), F.col("bank_card").alias("银行卡号"), remark.alias("备注"))).alias("json"))

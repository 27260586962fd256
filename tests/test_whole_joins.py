"""Joins meet every row of both tables."""

from agrarium.plans.catalog import QUERIES


def test_outer_chain_keeps_all_customers(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["join_chain_outer"](spark, folder)
    assert got.where("c_name IS NOT NULL").count() == spark.read.parquet(f"{folder}/customer.parquet").count() > 200
    assert got.where("s_name IS NOT NULL").count() == spark.read.parquet(f"{folder}/supplier.parquet").count()

"""Any kind of variant store by its path."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from locuspark.model import VariantSet
from locuspark.sources import tables, vcf, vcfzarr


def open_store(spark: SparkSession, path: str, backend: str | None = None, options: dict | None = None, fields: Sequence[str] | None = None) -> VariantSet:
    """VCF text (``.vcf``, ``.vcf.gz``), a Parquet variant set, or a store of chunked arrays (a folder, a zip file, a URL)."""
    if str(path).endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        return vcf.read(spark, str(path))
    if backend is None and "://" not in str(path) and (Path(path) / "about").is_dir():
        return tables.read(spark, str(path))
    if "://" in str(path) and backend is None and str(path).endswith(".variants"):
        return tables.read(spark, str(path))
    return vcfzarr.read(spark, path, backend, options, fields)

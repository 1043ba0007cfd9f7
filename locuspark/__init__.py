"""Variant analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the functions that run in Python workers by value, so that a
# cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

_WHERE = {
    "Field": "model", "VariantSet": "model", "VariantFilter": "plans.filters", "FilterExpression": "plans.filters", "open_store": "sources.opened", "is_missing": "functions.sentinels", "is_fill": "functions.sentinels", "trim_fill": "functions.sentinels",
    "FormatEncoder": "sinks.random_access", "BedEncoder": "sinks.random_access", "BgenEncoder": "sinks.random_access", "write_plink": "sinks.plink", "write_bim": "sinks.plink", "write_fam": "sinks.plink", "write_bgen": "sinks.bgen", "write_bgi": "sinks.bgen",
    "write_sample": "sinks.bgen", "ViewPlinkOptions": "cli", "ViewBgenOptions": "cli", "formatted": "plans.formats",
}
__all__ = [*sorted(_WHERE), "__version__", "write_vcf"]


def __getattr__(name: str):
    """Public names are imported when they are first used."""
    from importlib import import_module

    if name == "write_vcf":
        return import_module("locuspark.sinks.vcf").write
    if name in _WHERE:
        return getattr(import_module(f"locuspark.{_WHERE[name]}"), name)
    raise AttributeError(name)

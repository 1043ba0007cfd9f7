"""The commands ``index``, ``query``, ``view``, ``view-plink`` and ``view-bgen``."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from locuspark.model import VariantSet
from locuspark.operators import regions as R
from locuspark.operators import samples as S
from locuspark.operators import stats
from locuspark.plans import expression as X
from locuspark.plans.filters import FilterExpression
from locuspark.plans.formats import formatted
from locuspark.sinks import bgen, plink, vcf
from locuspark.sinks.ordered import in_order
from locuspark.sources.opened import open_store


class UsageError(Exception):
    """Options that do not go together; exit code 2."""


@dataclass(frozen=True)
class _Options:
    """A bundle of options that reads itself from parsed arguments."""

    @classmethod
    def of(cls, args: argparse.Namespace):
        return cls(**{f.name: getattr(args, f.name) for f in fields(cls) if hasattr(args, f.name)})


@dataclass(frozen=True)
class StoreOptions(_Options):
    backend_storage: str | None = None
    storage_options: dict = field(default_factory=dict)

    @staticmethod
    def add(parser: argparse.ArgumentParser) -> None:
        group = parser.add_argument_group("store")
        group.add_argument("--backend-storage", help="'fsspec' or 'obstore' for URLs; local paths need none")
        group.add_argument("--storage-option", action="append", default=[], metavar="KEY=VALUE", help="an option of the storage, JSON if it can be (repeatable)")

    @classmethod
    def of(cls, args: argparse.Namespace) -> StoreOptions:
        return cls(args.backend_storage, storage_options(args.storage_option))

    def open(self, spark: SparkSession, path: str) -> VariantSet:
        return open_store(spark, path, self.backend_storage, self.storage_options or None)


def storage_options(pairs: list[str]) -> dict:
    out = {}
    for pair in pairs:
        key, equals, value = pair.partition("=")
        if not equals:
            raise UsageError(f"--storage-option takes KEY=VALUE, not {pair!r}")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


@dataclass(frozen=True)
class LogOptions(_Options):
    log_level: str = "WARNING"
    log_file: str | None = None

    @staticmethod
    def add(parser: argparse.ArgumentParser) -> None:
        group = parser.add_argument_group("logging")
        group.add_argument("--log-level", type=str.upper, choices=["WARNING", "INFO", "DEBUG"], default="WARNING")
        group.add_argument("--log-file")

    def apply(self) -> None:
        to = logging.FileHandler(self.log_file) if self.log_file else logging.StreamHandler()
        logging.basicConfig(level=self.log_level, format="%(asctime)s %(name)s %(levelname)s %(message)s", handlers=[to], force=True)


@dataclass(frozen=True)
class SelectionOptions(_Options):
    regions: str | None = None
    regions_file: str | None = None
    targets: str | None = None
    targets_file: str | None = None
    samples: str | None = None
    samples_file: str | None = None
    force_samples: bool = False
    include: str | None = None
    exclude: str | None = None
    types: str | None = None
    exclude_types: str | None = None
    min_alleles: int | None = None
    max_alleles: int | None = None

    @staticmethod
    def add(parser: argparse.ArgumentParser, alleles: bool = True) -> None:
        group = parser.add_argument_group("selection")
        for short, long, text in (
            ("-r", "--regions", "regions that variants must overlap, comma separated"), ("-R", "--regions-file", "a file of regions"), ("-t", "--targets", "regions that positions must lie in; ^ for the complement"), ("-T", "--targets-file", "a file of targets; ^ for the complement"),
            ("-s", "--samples", "samples in this order; ^ for the complement"), ("-S", "--samples-file", "a file of samples; ^ for the complement"), ("-i", "--include", "keep sites where the expression holds"), ("-e", "--exclude", "drop sites where the expression holds"),
        ):
            group.add_argument(short, long, help=text)
        group.add_argument("--force-samples", action="store_true", help="only warn about unknown samples")
        if alleles:
            group.add_argument("-v", "--types", help="keep these types: snps, indels, mnps, other")
            group.add_argument("-V", "--exclude-types", help="drop these types")
            group.add_argument("-m", "--min-alleles", type=int)
            group.add_argument("-M", "--max-alleles", type=int)

    def apply(self, vs: VariantSet, mode: str = "native", view: bool = False, drop_genotypes: bool = False) -> VariantSet:
        """The selection in order: filters are parsed, samples, regions and targets chosen, semantics set, filters attached."""
        for a, b in (("regions", "regions_file"), ("targets", "targets_file"), ("samples", "samples_file"), ("include", "exclude"), ("types", "exclude_types")):
            if getattr(self, a) is not None and getattr(self, b) is not None:
                raise ValueError(f"--{a} and --{b} exclude each other".replace("_", "-"))
        found = [FilterExpression(self.include, self.exclude)] if self.include is not None or self.exclude is not None else []
        kinds = X.type_option(self.types, self.exclude_types)
        found += [FilterExpression(text) for text in ([kinds] if kinds else []) + X.allele_option(self.min_alleles, self.max_alleles)]
        if drop_genotypes:
            if any(f.scope(vs) == "sample" for f in found):
                raise ValueError("a filter over samples needs genotypes, which are dropped")
            vs = vs.with_samples([])
        elif self.samples is not None or self.samples_file is not None:
            names, complement = S.from_option(self.samples) if self.samples_file is None else S.from_file(self.samples_file)
            vs = vs.with_samples(names, complement, self.force_samples)
            if not vs.sample_ids:
                raise ValueError("an empty set of samples is not supported; drop the genotypes instead")
        if self.regions is not None or self.regions_file is not None:
            given = [R.parse(r) for r in self.regions.split(",")] if self.regions_file is None else R.from_file(self.regions_file)[0]
            vs = vs.with_regions(given)
        if self.targets is not None or self.targets_file is not None:
            vs = vs.with_targets(*(R.from_option(self.targets) if self.targets_file is None else R.from_file(self.targets_file)))
        vs = vs.with_mode(mode, view)
        for f in found:
            vs = vs.with_filter(f)
        return vs


def byte_size(text: str) -> int:
    """A number of bytes, with a unit of powers of 1024 if so wished: ``4096``, ``100M``, ``2GiB``."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:([kmgt])(?:i?b)?|b)?\s*", text, re.IGNORECASE)
    if not m or not int(m[1]):
        raise argparse.ArgumentTypeError(f"{text!r} is not a size in bytes")
    return int(m[1]) << 10 * (" kmgt".index(m[2].lower()) if m[2] else 0)


@dataclass(frozen=True)
class ReaderOptions(_Options):
    """How much is read by how many tasks, as Spark settings for the time of a command."""

    readahead_workers: int | None = None
    readahead_buffer_size: int | None = None
    encode_threads: int | None = None

    @staticmethod
    def add(parser: argparse.ArgumentParser) -> None:
        group = parser.add_argument_group("reader")
        group.add_argument("--readahead-workers", type=int, help="tasks that a scan of files has at least")
        group.add_argument("--readahead-buffer-size", type=byte_size, help="bytes of files that a task reads at most, such as 64M")
        group.add_argument("--encode-threads", type=int, help="tasks of each shuffle")

    @contextlib.contextmanager
    def applied(self, spark: SparkSession):
        given = {"spark.sql.files.minPartitionNum": self.readahead_workers, "spark.sql.files.maxPartitionBytes": self.readahead_buffer_size, "spark.sql.shuffle.partitions": self.encode_threads}
        for name, value in given.items():
            if value is not None and value < 1:
                raise ValueError(f"{name} cannot be {value}")
        given = {name: value for name, value in given.items() if value is not None}
        before = {name: spark.conf.get(name, None) for name in given}
        try:
            for name, value in given.items():
                spark.conf.set(name, str(value))
            yield
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@dataclass(frozen=True)
class ViewPlinkOptions:
    """The options of ``view-plink``, for other tools that write the same files."""

    selection: SelectionOptions = SelectionOptions()
    store: StoreOptions = StoreOptions()
    log: LogOptions = LogOptions()
    no_bim: bool = False
    no_fam: bool = False

    @staticmethod
    def add(parser: argparse.ArgumentParser) -> None:
        _common(parser)
        parser.add_argument("--no-bim", action="store_true")
        parser.add_argument("--no-fam", action="store_true")

    @classmethod
    def of(cls, args: argparse.Namespace) -> ViewPlinkOptions:
        return cls(SelectionOptions.of(args), StoreOptions.of(args), LogOptions.of(args), args.no_bim, args.no_fam)

    def variants(self, spark: SparkSession, path: str) -> VariantSet:
        return self.selection.apply(self.store.open(spark, path)).materialised()


def _pad(text: str) -> bytes:
    if len(text) != 1 or not text.isascii() or text == "\0":
        raise argparse.ArgumentTypeError(f"one ASCII character is expected, not {text!r}")
    return text.encode()


@dataclass(frozen=True)
class ViewBgenOptions:
    """The options of ``view-bgen``, for other tools that write the same files."""

    selection: SelectionOptions = SelectionOptions()
    store: StoreOptions = StoreOptions()
    log: LogOptions = LogOptions()
    variant_id_field: str = "rsid"
    total_string_length: int | None = None
    pad_byte: bytes | None = None
    unphased: bool = False
    no_header_samples: bool = False
    no_sample_file: bool = False
    no_bgi: bool = False

    @staticmethod
    def add(parser: argparse.ArgumentParser) -> None:
        _common(parser)
        parser.add_argument("--variant-id-field", choices=["rsid", "varid"], default="rsid")
        parser.add_argument("--total-string-length", type=int)
        parser.add_argument("--pad-byte", type=_pad)
        for flag in ("--unphased", "--no-header-samples", "--no-sample-file", "--no-bgi"):
            parser.add_argument(flag, action="store_true")

    @classmethod
    def of(cls, args: argparse.Namespace) -> ViewBgenOptions:
        own = {f.name: getattr(args, f.name) for f in fields(cls) if f.name not in ("selection", "store", "log")}
        return cls(SelectionOptions.of(args), StoreOptions.of(args), LogOptions.of(args), **own)

    def variants(self, spark: SparkSession, path: str) -> VariantSet:
        return self.selection.apply(self.store.open(spark, path)).materialised()


def _common(parser: argparse.ArgumentParser, selection: bool = True, alleles: bool = True) -> None:
    parser.add_argument("path")
    if selection:
        SelectionOptions.add(parser, alleles)
    StoreOptions.add(parser)
    LogOptions.add(parser)
    ReaderOptions.add(parser)


# --- commands -----------------------------------------------------------------------
def index(spark: SparkSession, args: argparse.Namespace, out) -> None:
    if args.nrecords and args.stats:
        raise UsageError("only one of --nrecords and --stats can be given")
    if not (args.nrecords or args.stats):
        raise UsageError("building an index is not supported; give --nrecords or --stats")
    (stats.write_count if args.nrecords else stats.write_contig_counts)(StoreOptions.of(args).open(spark, args.path), out)


def query(spark: SparkSession, args: argparse.Namespace, out) -> None:
    vs = StoreOptions.of(args).open(spark, args.path)
    if args.list_samples:
        print("\n".join(vs.sample_ids))
        return
    if args.format is None:
        raise UsageError("a format is needed: -f")
    vs = SelectionOptions.of(args).apply(vs, "bcftools")
    with vcf.opened(out) as f:
        for text in in_order(formatted(vs, args.format, not args.disable_automatic_newline), "text"):
            f.write(text.decode())


def updated(selection: SelectionOptions, fill: str | None, no_update: bool, drop_genotypes: bool) -> tuple[str, ...]:
    """The INFO keys that ``view`` computes anew: what is asked for, and AC and AN of a subset of samples."""
    chosen = selection.samples is not None or selection.samples_file is not None
    if chosen and drop_genotypes:
        raise ValueError("samples cannot be selected when genotypes are dropped")
    if fill is not None:
        if no_update or drop_genotypes:
            raise ValueError(f"--fill-tags cannot go with {'--no-update' if no_update else '--drop-genotypes'}")
        return vcf.fill_tags(fill)
    return ("AC", "AN") if chosen and not no_update else ()


def view(spark: SparkSession, args: argparse.Namespace, out) -> None:
    if isinstance(out, str) and out.rpartition(".")[2] in ("gz", "bgz", "bcf"):
        raise ValueError(f"only plain text can be written, not {out}")
    selection = SelectionOptions.of(args)
    fill = updated(selection, args.fill_tags, args.no_update, args.drop_genotypes)
    vs = selection.apply(StoreOptions.of(args).open(spark, args.path), "bcftools", view=True, drop_genotypes=args.drop_genotypes)
    fill = tuple(t for t in fill if vs.has_genotypes)
    vcf.write(vs, out, args.header_only, args.no_header, args.no_version, fill)


def view_plink(spark: SparkSession, args: argparse.Namespace, out) -> None:
    opts = ViewPlinkOptions.of(args)
    plink.write_plink(opts.variants(spark, args.path), args.output, not opts.no_bim, not opts.no_fam)


def view_bgen(spark: SparkSession, args: argparse.Namespace, out) -> None:
    opts = ViewBgenOptions.of(args)
    stem = args.output
    bgen.write_bgen(
        opts.variants(spark, args.path), sys.stdout.buffer if stem is None else f"{stem}.bgen", None if stem is None or opts.no_sample_file else f"{stem}.sample", None if stem is None or opts.no_bgi else f"{stem}.bgen.bgi",
        not opts.no_header_samples, args.compression_level, opts.unphased, opts.variant_id_field, args.fixed_variant_size, opts.total_string_length, opts.pad_byte,
    )


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locuspark", description="Query, filter and export genetic variants on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, text: str, **kind) -> argparse.ArgumentParser:
        # -h of view means --header-only, so help has its long form only
        p = commands.add_parser(name, help=text, description=text, add_help=False)
        p.add_argument("--help", action="help")
        p.set_defaults(run=run)
        if kind:
            _common(p, **kind)
        return p

    p = command("index", index, "Print the number of records, or counts by contig.", selection=False)
    p.add_argument("-n", "--nrecords", action="store_true")
    p.add_argument("-s", "--stats", action="store_true")
    p = command("query", query, "Print chosen fields in a format of your own.", alleles=False)
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-l", "--list-samples", action="store_true")
    p.add_argument("-f", "--format")
    p.add_argument("-N", "--disable-automatic-newline", action="store_true")
    p = command("view", view, "Write VCF text.", alleles=True)
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-h", "--header-only", action="store_true")
    p.add_argument("-H", "--no-header", action="store_true")
    p.add_argument("--no-version", action="store_true")
    p.add_argument("-I", "--no-update", action="store_true")
    p.add_argument("-G", "--drop-genotypes", action="store_true")
    p.add_argument("--fill-tags")
    p = command("view-plink", view_plink, "Write a PLINK 1 fileset.")
    ViewPlinkOptions.add(p)
    p.add_argument("-o", "--output", required=True)
    p = command("view-bgen", view_bgen, "Write a BGEN file.")
    ViewBgenOptions.add(p)
    p.add_argument("-o", "--output")
    p.add_argument("--compression-level", type=int, choices=range(-1, 10))
    p.add_argument("--fixed-variant-size", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; returns its exit code."""
    argv = sys.argv[1:] if argv is None else argv
    if any(a == "--zarr-backend-storage" or a.startswith("--zarr-backend-storage=") for a in argv):
        print("--zarr-backend-storage is deprecated; use --backend-storage", file=sys.stderr)
        argv = [a.replace("--zarr-backend-storage", "--backend-storage", 1) for a in argv]
    args = parser().parse_args(argv)
    LogOptions.of(args).apply()
    out = getattr(args, "output", "-")
    try:
        spark = spark or SparkSession.builder.appName("locuspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        with ReaderOptions.of(args).applied(spark):
            args.run(spark, args, sys.stdout if out in ("-", None) else out)
        sys.stdout.flush()
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())  # what is left is not wanted
        return 1
    except UsageError as e:
        print(f"usage: {e}", file=sys.stderr)
        return 2
    except (ValueError, NotImplementedError, OSError, PySparkException) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0

"""Command line over the store."""

from __future__ import annotations

import argparse
import sys
from importlib.util import find_spec

from keystrata.functions.grid import ChemistryDescriptors, OneCell, SuppliedDescriptors
from keystrata.operators.lookup import MissingInputs
from keystrata.plans.session import build_session
from keystrata.sources.csv_io import read_results, read_wanted, write_results
from keystrata.sources.layout import DatasetId, DatasetNotFound
from keystrata.store import SchemaMismatch, Store
from keystrata.sync import pull, push


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keystrata")
    p.add_argument("--root", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *extra: tuple[str, dict], bucket: bool = True, model: bool = True) -> None:
        c = sub.add_parser(name)
        if bucket:
            c.add_argument("-b", "--bucket", required=True)
        if model:
            c.add_argument("-m", "--model", required=True)
            c.add_argument("-v", "--version", default="v1")
        for flag, kw in extra:
            c.add_argument(flag, **kw)

    source, target = ("--input", {"required": True}), ("--output", {})
    add("write", source, ("--access", {"choices": ["public", "private", "both"], "required": True}), ("--mw", {"help": "column of the molecular weight"}), ("--logp", {"help": "column of logP"}))
    add("read", source, ("--output", {"required": True}), ("--approximate", {"action": "store_true"}), ("--lenient", {"action": "store_true"}))
    add("copy", ("--output", {}))
    add("move")
    add("remove", ("--yes", {"action": "store_true"}))
    add("inspect", ("--input", {}), target, bucket=False)
    add("catalog", ("--filter", {"default": ""}), target, model=False)
    add("pull", source, ("--remote", {"required": True}))
    add("push", ("--remote", {"required": True}), bucket=False)
    return p


def _descriptors(mw: str | None, logp: str | None):
    """Supplied columns where named, else RDKit where it is installed, else one cell for all keys."""
    if (mw is None) != (logp is None):
        raise ValueError("--mw and --logp go together")
    if mw is not None:
        return SuppliedDescriptors(mw, logp)
    return ChemistryDescriptors() if find_spec("rdkit") else OneCell()


def run(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session("keystrata-cli")
    store = Store(spark, a.root, provider=_descriptors(getattr(a, "mw", None), getattr(a, "logp", None)))
    ds = DatasetId(a.bucket, a.model, a.version) if hasattr(a, "bucket") and hasattr(a, "model") else None
    if a.command == "write":
        if a.bucket in (store.public, store.private):
            raise ValueError("rows are written to a project bucket, and copied to the default ones")
        s = store.write(ds, read_results(spark, a.input), access=a.access)
        print(f"new {s.new}, duplicates {s.duplicates}, blank {s.blank}, rejected {s.rejected}, {s.rows_per_second:.0f} rows/s")
    elif a.command == "read":
        write_results(store.read(ds, read_wanted(spark, a.input), approximate=a.approximate, strict=not a.lenient), a.output, single=True)
    elif a.command == "copy":
        print("private %d, public %d" % store.copy(ds, a.output, neighbours=True))
    elif a.command == "move":
        print("private %d, public %d" % store.move(ds))
    elif a.command == "remove":
        print(f"{store.remove(ds, a.yes)} files")
    elif a.command == "inspect":
        out = store.inspect_inputs(read_wanted(spark, a.input), a.model, a.version).drop("ord") if a.input else store.list_available(a.model, a.version)
        write_results(out, a.output, single=True) if a.output else out.show(max(1, out.count()), False)
    elif a.command == "catalog":
        found = store.catalog(a.bucket, a.filter)
        write_results(found, a.output, single=True) if a.output else found.show(max(1, found.count()), False)
    elif a.command == "pull":
        print(pull(Store(spark, a.remote), store, ds, read_wanted(spark, a.input), neighbours=True))
    elif a.command == "push":
        print(push(store, Store(spark, a.remote), a.model, a.version))
    return 0


def main() -> None:
    try:
        sys.exit(run())
    except (ValueError, LookupError, MissingInputs, DatasetNotFound, SchemaMismatch) as e:
        sys.exit(f"error: {e}")


if __name__ == "__main__":
    main()

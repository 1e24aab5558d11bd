"""Command line: ``python -m scanforge compress|export|validate|status|jobs ...``."""

from __future__ import annotations

import argparse

from . import api
from .session import build
from .sources.archive import PRESETS


def main(args: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="scanforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, operands in (("compress", ("path", "folder")), ("export", ("folder", "out")), ("validate", ("original", "rebuilt")), ("status", ("folder",)), ("jobs", ("log",))):
        own = commands.add_parser(name)
        for o in operands:
            own.add_argument(o)
        if name in ("compress", "export"):
            own.add_argument("--preset", choices=sorted(PRESETS), default="lossless")
        if name == "compress":
            own.add_argument("--keep-existing", action="store_true")
    said = vars(parser.parse_args(args))
    command = said.pop("command")
    if command in ("compress", "export"):
        said["options"] = api.Options(said.pop("preset"), said.pop("keep_existing", False))
    spark = spark or build()
    getattr(api, command)(spark, **said).show(1000, truncate=False)


if __name__ == "__main__":
    main()

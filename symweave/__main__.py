"""``python -m symweave ROOT -l LANGUAGE [-o OUTPUT] [--dump-type json|sqlite|parquet|none]``"""

from __future__ import annotations

import argparse
import logging
import time

from symweave.api import CodeAnalytics
from symweave.extract import LANGUAGES
from symweave.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="symweave", description="Index the functions and calls of a repository.")
    p.add_argument("root")
    p.add_argument("-l", "--language", choices=sorted(LANGUAGES), required=True)
    p.add_argument("-o", "--output", default="index.json")
    p.add_argument("--dump-type", "--dt", choices=["json", "sqlite", "parquet", "none"], default="json")
    p.add_argument("--mode", choices=["simple", "crossref"], default="simple")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    began = time.time()
    code = CodeAnalytics(session()).setup_repo_index(a.root, a.language, a.mode, "none")
    if a.dump_type != "none":
        code.dump_index(a.output, a.dump_type)
    totals = code.index.totals().first()
    logging.info("%d symbols, %d definitions, %d references in %.1f s", *totals, time.time() - began)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

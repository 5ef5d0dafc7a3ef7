"""Run a registered query: ``python -m triagekit <key> <tables_dir> [out_dir] [--explain]``.

Without ``out_dir`` the row count is printed; with it the result is written
as Parquet.  ``--list`` prints the registered keys.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from .plans.catalog import REGISTRY
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    if argv[0] == "--list":
        print("\n".join(sorted(REGISTRY)))
        return 0
    key, tables = argv[0], argv[1]
    rest = [a for a in argv[2:] if not a.startswith("--")]
    from .session import get_session
    spark = get_session(inputs=[tables])
    df = REGISTRY[key](spark, tables)
    if "--explain" in argv:
        df.explain("formatted")
    if rest:
        df.write.mode("errorifexists").parquet(rest[0])
    else:
        print(df.count())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

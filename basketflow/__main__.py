"""Command line of the application: ``python -m basketflow --base-path /retail``."""

import argparse
from dataclasses import MISSING, fields

from basketflow.plans.application import Settings, run
from basketflow.plans.session import build_session


def parse_arguments(argv: list[str] | None = None) -> Settings:
    """One option per field of :class:`Settings`; ``none`` lifts an optional number."""
    parser = argparse.ArgumentParser(prog="basketflow", description=Settings.__doc__)
    for item in fields(Settings):
        flag = "--" + item.name.replace("_", "-")
        if item.type is bool:
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=item.default)
        else:
            required = item.default is MISSING
            parser.add_argument(
                flag,
                required=required,
                default=None if required else item.default,
                type=_number if "int" in str(item.type) else str,
            )
    return Settings(**vars(parser.parse_args(argv)))


def _number(text: str) -> int | None:
    return None if text.lower() == "none" else int(text)


def main(argv: list[str] | None = None) -> None:
    settings = parse_arguments(argv)
    spark = build_session()
    spark.sparkContext.setLogLevel("WARN")
    run(spark, settings)


if __name__ == "__main__":
    main()

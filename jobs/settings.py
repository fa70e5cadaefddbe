"""What the command lines of the jobs share: settings from a file and from arguments, logs, a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession

from findery.session import session


def main(name: str, run: Callable[..., dict], argv: Sequence[str] | None = None) -> dict:
    """Runs a job in a session of its own. The file and the arguments give the keyword arguments of run; arguments are
    read as JSON where they can be, else as text."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", help="a JSON file of settings; its path may be remote")
    known, rest = parser.parse_known_args(argv)
    if len(rest) % 2 or any(not r.startswith("--") for r in rest[::2]):
        parser.error("settings are given as --name value")
    spark = session(name)
    try:
        settings = json.loads(spark.read.text(known.config, wholetext=True).first()[0]) if known.config else {}
        given = {k.removeprefix("--").replace("-", "_"): _value(v) for k, v in zip(rest[::2], rest[1::2], strict=True)}
        return run(spark, **settings | given)
    finally:
        spark.stop()


def _value(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


@contextmanager
def changed(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for the time of a block; underscores stand for dots."""
    names = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

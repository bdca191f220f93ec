"""A line-oriented shell: ``python -m loomgraph.cli PATH [--import-json F | --import-csv DIR | --import-ldbc-csv DIR]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from .lang.lexer import GqlError
from .session import GraphSession
from .sources import files

HELP = ".schema .graph-types .indexes .save .dump-json PATH .dump-gql PATH .limit N .timeout SECONDS .vec .help .quit"


class Shell:
    def __init__(self, session: GraphSession, out=None):
        self.session, self.out, self.limit = session, out, 100

    def say(self, text: object) -> None:
        print(text, file=self.out)

    def table(self, statement: str) -> None:
        df = self.session.execute(statement, self.limit if statement.lstrip().upper().startswith(("MATCH", "(")) else 0)
        self.say(" | ".join(df.columns))
        for r in df.collect():
            self.say(" | ".join("NULL" if v is None else str(v) for v in r))
        for w in self.session.warnings:
            self.say(f"warning: {w}")

    def line(self, text: str) -> bool:
        """Runs one line; False ends the shell."""
        text = text.strip()
        if not text:
            return True
        word, _, rest = text.partition(" ")
        try:
            match word:
                case ".quit":
                    return False
                case ".help":
                    self.say(HELP)
                case ".schema":
                    self.table("SHOW GRAPH TYPE DEFAULT")
                case ".graph-types":
                    self.table("SHOW GRAPH TYPES")
                case ".indexes":
                    self.table("SHOW INDEXES")
                case ".save":
                    self.session.save(rest or None)
                case ".dump-json":
                    Path(rest).write_text(self.session.to_json())
                case ".dump-gql":
                    Path(rest).write_text(self.session.to_gql())
                case ".timeout":
                    self.session.set_timeout(float(rest) or None)
                case ".vec":
                    for attr, (_, dim, metric) in sorted(self.session.graph.vectors.items()):
                        self.say(f"{attr}: {dim} dimensions, {metric}")
                case ".limit":
                    self.limit = int(rest)
                case _ if word.startswith("."):
                    self.say(f"unknown command {word}; {HELP}")
                case _:
                    self.table(text)
        except (GqlError, ValueError, OSError) as e:
            self.say(f"error: {e}")
        return True

    def run(self, lines: Iterable[str]) -> None:
        for text in lines:
            if not self.line(text):
                return


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("path")
    p.add_argument("--import-json")
    p.add_argument("--import-csv")
    p.add_argument("--import-ldbc-csv")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if a.import_json:
        session = GraphSession.import_json(spark, a.import_json, a.path)
    elif a.import_csv:
        session = GraphSession.import_csv(spark, a.import_csv, a.path)
    elif a.import_ldbc_csv:
        session = GraphSession(spark, files.graph_from_ldbc(spark, a.import_ldbc_csv), a.path)
    else:
        session = GraphSession.open(spark, a.path)
    Shell(session).run(sys.stdin)


if __name__ == "__main__":
    main()

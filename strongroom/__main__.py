"""``python -m strongroom VERB VAULT ...``: create, add, list, extract, delete, rename, info, compact, passwd.

The password comes from $STRONGROOM_PASSWORD or a prompt; the new one of passwd from $STRONGROOM_NEW_PASSWORD.
"""

from __future__ import annotations

import argparse
import getpass
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strongroom.functions.text import generate_grouped_password
from strongroom.plans.vault import KdfParams, Vault, VaultError
from strongroom.sources.directory import DirectorySource

VERBS = {"create": [], "add": ["source"], "list": [], "extract": ["name", "dest"], "delete": ["name"], "rename": ["name", "new_name"], "info": [], "compact": [], "passwd": []}


def _password(variable: str, prompt: str) -> str:
    return os.environ.get(variable) or getpass.getpass(prompt)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strongroom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, more in VERBS.items():
        sub = verbs.add_parser(verb)
        for name in ["vault", *more]:
            sub.add_argument(name)
        if verb in ("create", "passwd"):
            sub.add_argument("--memory", type=int, default=256, choices=(128, 256, 512))
            sub.add_argument("--generate-password", action="store_true")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("strongroom").getOrCreate()
    try:
        if a.verb == "create":
            password = generate_grouped_password() if a.generate_password else _password("STRONGROOM_PASSWORD", "Password: ")
            Vault.create(spark, a.vault, password, KdfParams(a.memory))
            if a.generate_password:
                print(password)
            return 0
        v = Vault.open(spark, a.vault, _password("STRONGROOM_PASSWORD", "Password: "))
        if a.verb == "add":
            spark.dataSource.register(DirectorySource)
            items = spark.read.format("directory").load(a.source)
            print(v.add_paths(items.select("name", "content").withColumn("pos", F.monotonically_increasing_id())))
        elif a.verb == "list":
            for r in v.list_file_info().orderBy("name").toLocalIterator():
                print(r["name"], r["size"], r["storage_used"], sep="\t")
        elif a.verb == "extract":
            with open(f"{a.dest}.part", "wb") as file:
                for window in v.read_windows(a.name):
                    file.write(window)
            os.replace(f"{a.dest}.part", a.dest)
        elif a.verb == "delete":
            v.delete(a.name)
        elif a.verb == "rename":
            v.rename(a.name, a.new_name)
        elif a.verb == "info":
            print(json.dumps(v.info()))
        elif a.verb == "compact":
            v.compact()
        elif a.verb == "passwd":
            new = generate_grouped_password() if a.generate_password else _password("STRONGROOM_NEW_PASSWORD", "New password: ")
            v.change_password(new, KdfParams(a.memory))
            if a.generate_password:
                print(new)
    except VaultError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

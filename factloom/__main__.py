"""python -m factloom VAULT COMMAND [TEXT] [--name=value flags]: ping, index, search, verify or cite over a vault, as JSON lines.

python -m factloom VAULT edit PATH OLD NEW [TOKEN]: preview an edit, or, with its token, make it.
python -m factloom VAULT restore PATH SNAPSHOT: bring a snapshot back.
"""

from __future__ import annotations

import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from factloom.config import EngineConfig
from factloom.engine import Engine


def main(args: list[str]) -> int:
    plain = [a for a in args if not a.startswith("--")]
    sizes = {"edit": (5, 6), "restore": (4,)}
    if len(plain) < 2 or plain[1] not in ("ping", "index", "search", "verify", "cite", *sizes) or len(plain) not in sizes.get(plain[1], (len(plain),)):
        print(__doc__, file=sys.stderr)
        return 2
    vault, command, text = plain[0], plain[1], " ".join(plain[2:])
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    engine = Engine(spark, vault, config=EngineConfig.from_args([a for a in args if a.startswith("--")]))
    if command == "ping":
        print(json.dumps(engine.ping()))
        return 0
    if command in sizes:
        done = engine.safe_edit(*plain[2:]) if command == "edit" else engine.restore(*plain[2:])
        print(json.dumps(dataclasses.asdict(done)))
        return 0
    stats = engine.index_all()
    if command == "index":
        print(json.dumps(stats))
        return 0
    rows = {"search": engine.search, "verify": engine.verify, "cite": engine.cite}[command](text)
    for line in rows.toJSON().collect():  # an answer, or at most as many rows as a search may give
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

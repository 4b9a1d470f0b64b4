"""python -m kgloom CONFIG [OUT]: builds the tables and triples of the sources that a configuration names.

{"sources": ["curated", "commonsense", ...], "language": "en", "should_cluster": true, "edge_mappings": [paths],
 "files": {"commonsense": path, "dictionary": path, "curated": path of word lists, "curated_edges": path}}
"""

from __future__ import annotations

import sys

from kgloom import config as conf


def build(spark, config: dict) -> dict:
    """Tables of the configured sources, the first of highest priority."""
    from kgloom.operators import mapping
    from kgloom.sources import loaders, readers

    files, lang = config["files"], config.get("language", "en")
    made = {
        "commonsense": lambda: loaders.commonsense(readers.commonsense_edges(spark, files["commonsense"]), lang),
        "dictionary": lambda: loaders.dictionary(readers.dictionary(spark, files["dictionary"]), readers.RELATIONS, config.get("lemmas"), lang=lang),
        "curated": lambda: loaders.curated(readers.word_lists(spark, files["curated"], True), readers.edge_patterns(spark.read.text(files["curated_edges"])) if "curated_edges" in files else None),
    }
    unknown = [s for s in config["sources"] if s not in made]
    if unknown:
        raise ValueError(f"unknown sources {unknown}; there are {sorted(made)}")
    maps = [mapping.load_json(p) for p in config.get("edge_mappings", [])]
    return loaders.build(spark, [made[s]() for s in config["sources"]], mapping.edge_map(spark, maps) if maps else None, config.get("should_cluster", True))


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    from kgloom.operators.rdf import ntriples
    from kgloom.session import get_session

    spark = get_session()
    out = build(spark, conf.read(args[0]))
    folder = args[1] if len(args) > 1 else "kgloom-out"
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if "triples" in out:
        ntriples(spark.read.parquet(f"{folder}/triples")).write.mode("overwrite").text(f"{folder}/ntriples")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Signal registry, assembly of feature tables and feature tags."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """A table of node signals: its tag, category, columns, and the value of nodes it does not cover."""

    tag: str
    category: str
    columns: tuple[str, ...]
    fill: float = 0.0
    kind: str = "float"


def _dims(prefix: str, n: int = 64) -> tuple[str, ...]:
    return tuple(f"{prefix}{i}" for i in range(n))


# The signals, in the order of their tags.
SIGNALS: dict[str, Signal] = {
    "deg_cent": Signal("I1", "Centrality", ("gi_degree_centrality",)),
    "inout": Signal("I2", "Centrality", ("gi_in_degree", "gi_out_degree")),
    "pagerank": Signal("I3", "Centrality", ("gi_pagerank",)),
    "betweenness": Signal("I4", "Centrality", ("gi_betweenness_centrality",)),
    "eigenvector": Signal("I5", "Centrality", ("gi_eigenvector_centrality",)),
    "closeness": Signal("I6", "Centrality", ("gi_closeness_centrality",)),
    "clustering": Signal("I7", "Cohesion", ("gi_clustering_coefficient",)),
    "square_clustering": Signal("I8", "Cohesion", ("gi_square_clustering",)),
    "core": Signal("I9", "Cohesion", ("gi_core_number",)),
    "triangles": Signal("I10", "Cohesion", ("gi_triangles",)),
    "louvain": Signal("I11", "Community", ("gi_comm_size", "gi_comm_density", "gi_comm_is_small", *(f"gi_comm_code_{i}" for i in range(1, 6)))),
    "leiden": Signal("I12", "Community", ("gi_leiden_comm",), -1, "int"),
    "infomap": Signal("I13", "Community", ("gi_infomap_comm",), -1, "int"),
    "node2vec_bal": Signal("N2VBal", "Proximity", _dims("emb_n2v_bal_")),
    "node2vec_dfs": Signal("N2VDFS", "Proximity", _dims("emb_n2v_dfs_")),
    "node2vec_bfs": Signal("N2VBFS", "Proximity", _dims("emb_n2v_bfs_")),
    "deepwalk": Signal("DeepWalk", "Proximity", _dims("emb_dw_")),
    "spectral": Signal("1Spectral", "Spectral", _dims("emb_spectral_")),
    "ffstruc2vec": Signal("1ff2Vec", "Structure", _dims("emb_ffstruc2vec_")),
    "graphwave": Signal("1Graphwave", "Structure", _dims("emb_graphwave_")),
    "role2vec": Signal("1Role2Vec", "Structure", _dims("emb_role2vec_")),
    "gcn": Signal("1GCN", "GNN", ()),
    "gat": Signal("1GAT", "GNN", ()),
    "gcl": Signal("1GCL", "GNN", ()),
}
_EMBEDDINGS = ("spectral", "ffstruc2vec", "graphwave", "role2vec", "gcn", "gat", "gcl")
_PROXIMITY = ("node2vec_bal", "node2vec_dfs", "node2vec_bfs", "deepwalk")


@dataclass
class FeatureSet:
    """Which signals a feature table carries, on which graph variant and split."""

    signals: tuple[str, ...] = ()
    variant: str | None = None
    split_seed: int = 1
    validation: float = 0.2
    test: float = 0.2
    base: str = "base93"
    extra: dict[str, object] = field(default_factory=dict)

    @classmethod
    def parse(cls, tokens: str, **more) -> FeatureSet:
        """Signals from a list separated by spaces or commas; ``base`` alone names none."""
        names = [t for t in tokens.replace(",", " ").lower().split() if t != "base"]
        if wrong := [t for t in names if t not in SIGNALS]:
            raise ValueError(f"unknown signals {wrong}")
        return cls(tuple(s for s in SIGNALS if s in names), **more)

    @property
    def tag(self) -> str:
        """The tag that names the set in artifacts."""
        has = set(self.signals)
        indicators = [s.tag for n, s in SIGNALS.items() if s.tag[0] == "I" and n in has]
        off = lambda n: SIGNALS[n].tag if n in has else "0" + SIGNALS[n].tag[1:]
        near = [SIGNALS[n].tag for n in _PROXIMITY if n in has]
        parts = [self.base, *(indicators or ["noInd"]), *map(off, _EMBEDDINGS), *(near or ["0Prox"])]
        return "+".join(parts) + f"_edgesVar_{self.variant}_splitseed{self.split_seed}_random_val{round(self.validation * 100)}_test{round(self.test * 100)}"


def assemble(base: DataFrame, signals: dict[str, DataFrame], key: str = "tx_id") -> DataFrame:
    """``base`` left-joined with every signal table on the key; missing values filled and narrowed.

    A signal table is ``id`` or ``tx_id`` and its columns.  Fills and casts are one
    projection after the joins, so the plan stays a chain of joins on one key.
    """
    def join(left: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        _, right = item
        return left.join(right.withColumnRenamed("id", key) if "id" in right.columns else right, key, "left")

    wide = reduce(join, signals.items(), base)
    added = {c: SIGNALS[n] for n, t in signals.items() for c in t.columns if c not in ("id", key)}
    cast = [F.coalesce(F.col(c), F.lit(added[c].fill)).cast(added[c].kind).alias(c) if c in added else F.col(c) for c in wide.columns]
    return wide.select(*cast)


def coverage(ids: DataFrame, emb: DataFrame, columns: list[str], key: str = "tx_id") -> DataFrame:
    """``n_ids, n_covered``: ids whose embedding is not all zero."""
    total = sum((F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in columns), F.lit(0.0))
    return ids.join(emb, key, "left").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(total > 0).alias("n_covered"))


def match_baseline(artifacts: DataFrame, params: DataFrame) -> DataFrame:
    """Artifacts with the parameters of the one baseline run of the same base block and model.

    Fails where a block has no baseline or more than one.
    """
    n = params.groupBy("model", "base_block").agg(F.count(F.lit(1)).alias("_n"), F.first("params").alias("params"))
    found = artifacts.join(n, ["model", "base_block"], "left")
    bad = F.raise_error(F.concat(F.lit("no unique baseline for "), F.col("base_block")))
    return found.withColumn("params", F.when(F.coalesce("_n", F.lit(0)) == 1, F.col("params")).otherwise(bad)).drop("_n")

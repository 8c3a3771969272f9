"""The saved model: tables, fact and causes on disk, refreshed as a whole and opened many times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shipcause.operators.causes import MODEL_RULES, Rule, explode_causes, infer_causes
from shipcause.operators.fact import MONTH, build_fact
from shipcause.operators.feedback import feedback_summary_model, feedback_text, feedback_text_rows
from shipcause.operators.firsts import worst_factor
from shipcause.operators.measures import cause_counts, model_stats
from shipcause.sources.presence import require_sources
from shipcause.sources.store import write_table, write_tables
from shipcause.sources.tables import load_csv_tables, load_parquet_tables, register_views, row_counts
from shipcause.sources.versions import current, discard, new_version, prune, publish


@dataclass(frozen=True)
class Model:
    tables: Mapping[str, DataFrame]
    fact: DataFrame
    causes: DataFrame

    def register(self) -> None:
        """Make everything available to SQL under its usual names."""
        register_views(self.tables)
        register_views(
            {
                "v_external_best": worst_factor(self.tables["raw_external_factors"]),
                "v_feedback_summary": feedback_summary_model(self.tables["raw_feedback"]).join(
                    feedback_text(self.tables["raw_feedback"]), "order_id", "left"
                ),
                "feedback_text_rows": feedback_text_rows(self.tables["raw_feedback"]),
                "fact_order_analysis": self.fact,
                "fact_order_causes": self.causes,
                "v_cause_summary": cause_counts(self.fact),
            }
        )

    def load_stats(self) -> DataFrame:
        return row_counts(self.tables)

    def model_stats(self) -> DataFrame:
        return model_stats(self.fact)


def model_of(tables: Mapping[str, DataFrame], rules: Sequence[Rule] = MODEL_RULES) -> Model:
    """The model over the tables as lazy plans. The fact keeps which words its feedback holds, so that
    causes can be inferred from it again."""
    fact = infer_causes(build_fact(tables, "model", rules=rules), rules)
    return Model(tables, fact, explode_causes(fact))


def save_model(tables: Mapping[str, DataFrame], folder: str, rules: Sequence[Rule] = MODEL_RULES) -> Model:
    """Write the fact, by order month, then the causes from the written fact: the joins run once."""
    saved = write_table(model_of(tables, rules).fact, f"{folder}/fact_order_analysis", partition_by=MONTH)
    causes = write_table(explode_causes(saved), f"{folder}/fact_order_causes")
    return Model(tables, saved, causes)


def refresh(
    spark: SparkSession, data_folder: str, folder: str, formats: Sequence[str] = (), on_reject: str = "fail", keep: int = 2
) -> Model:
    """CSV files to tables, tables to fact and causes, as a new version of the model in ``folder``.

    Readers who open the model meanwhile get the version before; it is switched once everything is written, and
    a build that fails leaves no trace. The newest ``keep`` versions stay, so that jobs on the one before can end.
    ``formats`` are date patterns to try after the ISO forms; ``on_reject`` as in ``read_csv``.
    """
    require_sources(spark, data_folder)
    version = new_version(folder)
    try:
        loaded = load_csv_tables(spark, data_folder, formats, on_reject)
        written = write_tables({f"{version}/{name}": df for name, df in loaded.items()})
        save_model(dict(zip(loaded, written.values())), version)
    except BaseException:
        discard(spark, version)
        raise
    publish(spark, folder, version)
    prune(spark, folder, keep)
    return open_model(spark, folder)


def open_model(spark: SparkSession, folder: str) -> Model:
    """The version that the last complete :func:`refresh` left in ``folder``."""
    version = current(spark, folder)
    model = Model(
        load_parquet_tables(spark, version),
        spark.read.parquet(f"{version}/fact_order_analysis"),
        spark.read.parquet(f"{version}/fact_order_causes"),
    )
    model.register()
    return model

"""Canonical event names (J-10 / S-15) and the event handler registry (F-01).

The name map is a 33-row dimension joined by broadcast: its size is fixed by
the list below, not by the data, so the broadcast is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNSUPPORTED = "Unsupport"

# Pallet -> canonical pallet key and the events it names, in
# the order the runtime declares them. Balances.Upgraded is reported as
# "ReserveRepatriated" by the reference; ``reference_quirk=True`` reproduces
# that, the default keeps "Upgraded".
PALLET_KEYS = {
    "System": "system",
    "Balances": "balances",
    "TransactionPayment": "transaction_payment",
    "Utility": "utility",
}
PALLET_EVENTS = {
    "System": ["ExtrinsicSuccess", "ExtrinsicFailed", "CodeUpdated", "NewAccount",
               "KilledAccount", "Remarked"],
    "Balances": ["Endowed", "DustLost", "Transfer", "BalanceSet", "Reserved", "Unreserved",
                 "ReserveRepatriated", "Deposit", "Withdraw", "Slashed", "Minted", "Burned",
                 "Restored", "Upgraded", "Issued", "Rescinded", "Locked", "Unlocked",
                 "Frozen", "Thawed"],
    "TransactionPayment": ["TransactionFeePaid"],
    "Utility": ["BatchInterrupted", "BatchCompleted", "BatchCompletedWithErrors",
                "ItemCompleted", "ItemFailed", "DispatchedAs"],
}
QUIRK_RENAMES = {("Balances", "Upgraded"): "ReserveRepatriated"}


def name_rows(reference_quirk: bool = False) -> list[tuple[str, str, str, str]]:
    rows = []
    for pallet, events in PALLET_EVENTS.items():
        for ev in events:
            canon = QUIRK_RENAMES.get((pallet, ev), ev) if reference_quirk else ev
            rows.append((pallet, ev, PALLET_KEYS[pallet], canon))
    return rows


def name_dimension(spark: SparkSession, reference_quirk: bool = False) -> DataFrame:
    return spark.createDataFrame(
        name_rows(reference_quirk),
        "dim_pallet string, dim_event string, canonical_pallet string, canonical_event string")


def canonical_event_name(events: DataFrame, reference_quirk: bool = False,
                         pallet_col: str = "mod_name", event_col: str = "event_name") -> DataFrame:
    """Add ``canonical_pallet`` / ``canonical_event``. A listed pallet with an
    unlisted event gives ``Unsupport``; an unlisted pallet gives a NULL
    pallet key and ``Unsupport`` (the reference panics there)."""
    dim = F.broadcast(name_dimension(events.sparkSession, reference_quirk))
    joined = events.join(
        dim, (F.col(pallet_col) == F.col("dim_pallet")) & (F.col(event_col) == F.col("dim_event")),
        "left")
    pallet_key = F.create_map(*[x for kv in PALLET_KEYS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (joined
            .withColumn("canonical_pallet", F.coalesce(F.col("canonical_pallet"),
                                                       F.try_element_at(pallet_key, F.col(pallet_col))))
            .withColumn("canonical_event", F.coalesce(F.col("canonical_event"), F.lit(UNSUPPORTED)))
            .drop("dim_pallet", "dim_event"))


# F-01 --------------------------------------------------------------------
Handler = Callable[[DataFrame], DataFrame]


class HandlerRegistry:
    """Handlers of ``(pallet, event)`` keys. A handler is either a DataFrame
    transform of the events of its key (:meth:`register`, any operations, a scan
    each) or a set of columns (:meth:`register_fields`), of which any number run
    in one scan. Events without a handler are skipped, as in the reference."""

    def __init__(self) -> None:
        self._handlers: dict[str, tuple[str, str, Handler]] = {}
        self._fields: dict[str, tuple[str, str, dict[str, Column]]] = {}

    def _free(self, name: str) -> None:
        if name in self._handlers or name in self._fields:
            raise ValueError(f"duplicate handler {name!r}")

    def register(self, pallet: str, event: str, name: str, fn: Handler) -> "HandlerRegistry":
        self._free(name)
        self._handlers[name] = (pallet, event, fn)
        return self

    def register_fields(self, pallet: str, event: str, name: str, fields: dict[str, Column]) -> "HandlerRegistry":
        self._free(name)
        self._fields[name] = (pallet, event, fields)
        return self

    def keys(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys((p, e) for p, e, _ in [*self._handlers.values(), *self._fields.values()]))

    def apply(self, events: DataFrame) -> dict[str, DataFrame]:
        """One lazy table per handler; its key is a pushed-down filter."""
        def of(pallet: str, event: str) -> DataFrame:
            return events.where((F.col("mod_name") == pallet) & (F.col("event_name") == event))
        out = {name: fn(of(p, e)) for name, (p, e, fn) in self._handlers.items()}
        return out | {name: of(p, e).select(*[c.alias(k) for k, c in fields.items()]) for name, (p, e, fields) in self._fields.items()}

    def dispatch(self, events: DataFrame) -> DataFrame:
        """The column handlers in one scan: a row per event and handler, with
        ``handler`` and, in a struct column named after each handler, its
        columns (NULL in the rows of others). Events are tagged by a map
        look-up; the scan is filtered to the keys there are."""
        by_key: dict[tuple[str, str], list[str]] = {}
        for name, (pallet, event, _) in self._fields.items():
            by_key.setdefault((pallet, event), []).append(name)
        text = lambda p, e: F.concat_ws("\n", p, e)
        lookup = F.create_map(*[x for (p, e), names in by_key.items()
                                for x in (text(F.lit(p), F.lit(e)), F.array(*[F.lit(n) for n in names]))])
        known = (F.col("mod_name").isin(sorted({p for p, _ in by_key})) & F.col("event_name").isin(sorted({e for _, e in by_key})))
        tagged = events.where(known).withColumn("handler", F.explode(F.try_element_at(lookup, text(F.col("mod_name"), F.col("event_name")))))
        return tagged.select("handler", *[F.when(F.col("handler") == name, F.struct(*[c.alias(k) for k, c in fields.items()])).alias(name)
                                          for name, (_, _, fields) in self._fields.items()])

    def write_all(self, events: DataFrame, root: str) -> None:
        """Write the tables of all column handlers in one job:
        ``<root>/handler=<name>``, read by :meth:`table`."""
        self.dispatch(events).write.partitionBy("handler").parquet(root)

    def table(self, spark: SparkSession, root: str, name: str) -> DataFrame:
        """A handler's table of :meth:`write_all`: one folder, its own columns."""
        return spark.read.parquet(root).where(F.col("handler") == name).select(f"{name}.*")

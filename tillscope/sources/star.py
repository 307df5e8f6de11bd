"""The six tables an analysis works on, and how to read them at rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources.published import current
from tillscope.sources.schema import TABLES


class Star:
    """The six tables; each is read when an analysis first asks for it."""

    def __init__(
        self,
        read: Callable[[str], DataFrame],
        order_facts: DataFrame | None = None,
        basket_facts: DataFrame | None = None,
    ) -> None:
        self._read = read
        self._tables: dict[str, DataFrame] = {}
        #: order-grain facts kept at rest, see ``tillscope.plans.facts``
        self.order_facts = order_facts
        #: facts per order and product at rest, see ``tillscope.plans.basket_facts``
        self.basket_facts = basket_facts

    @classmethod
    def of(cls, **frames: DataFrame) -> Star:
        return cls(frames.__getitem__)

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}; the star has {', '.join(TABLES)}")
        if name not in self._tables:
            self._tables[name] = self._read(name)
        return self._tables[name]

    def with_order_facts(self, facts: DataFrame) -> Star:
        return Star(self.table, facts, self.basket_facts)

    def with_basket_facts(self, facts: DataFrame) -> Star:
        return Star(self.table, self.order_facts, facts)

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def stores(self) -> DataFrame:
        return self.table("stores")

    @property
    def promotions(self) -> DataFrame:
        return self.table("promotions")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def order_items(self) -> DataFrame:
        return self.table("order_items")


def read_star(spark: SparkSession, root: str) -> Star:
    """Read the tables that ``tillscope.sources.load.load_tables`` last published.

    The declared schema is given, so no data file is opened before a query runs.
    """
    folders = current(spark, root)
    return Star(lambda name: spark.read.schema(TABLES[name].struct).parquet(folders[name]))


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Put the declared default where a value is absent."""
    spec = TABLES[table]
    if not spec.defaults:
        return df
    kinds = dict(spec.columns)
    return df.withColumns(
        {
            column: F.coalesce(F.col(column), F.expr(literal).cast(kinds[column]))
            for column, literal in spec.defaults.items()
        }
    )

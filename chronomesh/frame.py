"""The event frame: a lazy DataFrame with roles, metadata and lineage."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.schema import EventMetadata, EventSchema, Lineage, Needs, OutputModality


class EventFrame:
    """Immutable; every method returns a new frame and nothing runs before an action."""

    __slots__ = ("df", "metadata", "schema")

    def __init__(self, df: DataFrame, schema: EventSchema, metadata: EventMetadata):
        modalities = schema.output_modalities | metadata.output_modalities
        provenance = {**metadata.feature_provenance, **schema.feature_provenance}
        needs = metadata.context_requirements.merged(schema.context_requirements)
        both = {"output_modalities": modalities, "feature_provenance": provenance, "context_requirements": needs}
        object.__setattr__(self, "df", df)
        object.__setattr__(self, "schema", schema.model_copy(update=both))
        object.__setattr__(self, "metadata", metadata.model_copy(update=both))

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("an event frame is immutable")

    @property
    def lazy_frame(self) -> DataFrame:
        return self.df

    # -- rebuilding ---------------------------------------------------------
    def with_df(self, df: DataFrame) -> EventFrame:
        return EventFrame(df, self.schema, self.metadata)

    with_lazy_frame = with_df

    def with_metadata(self, **updates: Any) -> EventFrame:
        return EventFrame(self.df, self.schema, self.metadata.model_copy(update=updates))

    def with_schema(self, **updates: Any) -> EventFrame:
        return EventFrame(self.df, EventSchema.model_validate({**self.schema.model_dump(), **updates}), self.metadata)

    def add_output_modality(self, modality: str | OutputModality) -> EventFrame:
        found = OutputModality(modality)  # ValueError on an unknown one
        more = self.schema.output_modalities | {found}
        return EventFrame(self.df, self.schema.model_copy(update={"output_modalities": more}), self.metadata)

    def register_feature(
        self, name: str, info: dict[str, Any] | None = None, modality: str | OutputModality | None = None, provenance: Lineage | None = None
    ) -> EventFrame:
        catalog = {**self.metadata.feature_catalog, name: dict(info or {})}
        made = {**self.schema.feature_provenance, **({name: provenance} if provenance else {})}
        out = EventFrame(self.df, self.schema.model_copy(update={"feature_provenance": made}), self.metadata.model_copy(update={"feature_catalog": catalog}))
        return out.add_output_modality(modality) if modality else out

    def require_context(
        self, *, spatial_crs: str | None = None, temporal_resolution: str | None = None, context_tags: Iterable[str] = ()
    ) -> EventFrame:
        more = Needs(spatial_crs=spatial_crs, temporal_resolution=temporal_resolution, required_context=set(context_tags))
        merged = self.schema.context_requirements.merged(more)
        return EventFrame(self.df, self.schema.model_copy(update={"context_requirements": merged}), self.metadata)

    def produced(self, df: DataFrame, step: str, columns: Iterable[str], inputs: Iterable[str] = (), tags: Iterable[str] = (), **details: Any) -> EventFrame:
        """The frame with new data and the lineage of the columns that a step made."""
        made = {c: Lineage(produced_by=step, inputs=list(inputs), tags=set(tags), details=details) for c in columns}
        catalog = {**self.metadata.feature_catalog, **{c: {"step": step, **details} for c in made}}
        schema = self.schema.model_copy(update={"feature_provenance": {**self.schema.feature_provenance, **made}})
        return EventFrame(df, schema, self.metadata.model_copy(update={"feature_catalog": catalog}))

    # -- relational ---------------------------------------------------------
    def select(self, *exprs: Column | str) -> EventFrame:
        return self.with_df(self.df.select(*exprs))

    def filter(self, *predicates: Column) -> EventFrame:
        return self.with_df(self.df.where(reduce(lambda a, b: a & b, predicates)) if predicates else self.df)

    def with_columns(self, *exprs: Column, **named: Column) -> EventFrame:
        """Add or replace columns; all expressions see the frame as it was."""
        if exprs:
            names = self.df.select(*exprs).columns
            return self.with_df(self.df.withColumns({**dict(zip(names, exprs)), **named}))
        return self.with_df(self.df.withColumns(named))

    def sort(self, by: str | list[str], descending: bool = False) -> EventFrame:
        """A total sort, nulls first."""
        order = Column.desc_nulls_first if descending else Column.asc_nulls_first
        return self.with_df(self.df.orderBy(*(order(F.col(c)) for c in ([by] if isinstance(by, str) else by))))

    # -- actions ------------------------------------------------------------
    def head(self, n: int = 5):
        return self.df.limit(n).toPandas()

    def collect(self):
        return self.df.toPandas()

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def describe(self):
        return self.df.summary().toPandas()

    def __repr__(self) -> str:
        return f"EventFrame({self.metadata.dataset_name}, crs={self.metadata.crs}, columns={self.df.columns})"

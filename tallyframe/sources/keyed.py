"""Result tables in buckets by key, merged copy-on-write: a batch rewrites the buckets it touches and nothing else.

A table is a folder. Each merge writes the new state of its buckets under a folder of its own and then publishes a manifest, a small
file that names the folder of every bucket; readers see either all of a merge or nothing of it. Merging the last batch again
starts from the manifest before it, so a retried or replayed batch gives the same table. Folders that neither the last
manifest nor the one before it names are deleted, so the number of files is bounded by buckets and their size, not by batches or exports.

Only the touched buckets are listed and read. Large buckets are split into several files by size, so a key that
holds a third of all rows does not fill one task. The driver sees bucket numbers and the manifest, at most `buckets` entries.
One writer at a time. Rows whose keys are null are kept in the bucket of null keys; empty updates change nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.schema import KEYS
from tallyframe.session import cut


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, by: list[str] | None = None, buckets: int = 64) -> None:
        """by: columns that name a row's bucket; a stored table keeps the number of buckets it was made with."""
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by or KEYS)
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        found = self._manifests()
        self.buckets = found[-1][1]["count"] if found else buckets

    # ---- manifests ---------------------------------------------------------------------------------

    def _manifests(self) -> list[tuple[int, dict]]:
        """The published manifests (two at most are kept), oldest first."""
        if not self._fs.exists(self._at("_manifest")):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("_manifest")))
        out = []
        for name in [n for n in names if n.endswith(".json")][-2:]:
            stream = self._fs.open(self._at(f"_manifest/{name}"))
            try:
                out.append((int(name[:-5]), json.loads(self._text(stream))))
            finally:
                stream.close()
        return out

    def _publish(self, number: int, manifest: dict) -> None:
        draft, final = self._at(f"_manifest/{number:012d}.draft"), self._at(f"_manifest/{number:012d}.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        if self._fs.exists(final):  # the same batch again
            self._fs.delete(final, False)
        self._fs.rename(draft, final)

    def _tidy(self) -> None:
        """Delete what no kept manifest names."""
        kept = self._manifests()
        named = {folder for _, m in kept for folder in m["folders"].values()}
        for name in [f.getPath().getName() for f in self._fs.listStatus(self._at("_manifest"))]:
            if name.endswith(".json") and int(name[:-5]) < kept[0][0]:
                self._fs.delete(self._at(f"_manifest/{name}"), False)
        for version in [f.getPath().getName() for f in self._fs.listStatus(self._at("")) if f.getPath().getName().startswith("v")]:
            inside = [f.getPath().getName() for f in self._fs.listStatus(self._at(version)) if "=" in f.getPath().getName()]
            gone = [b for b in inside if f"{version}/{b}" not in named]
            if len(gone) == len(inside):
                self._fs.delete(self._at(version), True)
                continue
            for b in gone:
                self._fs.delete(self._at(f"{version}/{b}"), True)

    # ---- reading -----------------------------------------------------------------------------------

    def _numbered(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.by]), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._numbered()).distinct().collect())  # at most `buckets`

    def _rows(self, manifest: dict, some: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f for b, f in manifest["folders"].items() if some is None or int(b) in some]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, keys: DataFrame | None = None, before: str | None = None) -> DataFrame | None:
        """The table, or None before the first merge; with `keys`, only the buckets that can hold one of them; with `before`, as
        it was before that batch, if that was the last one."""
        found = self._manifests()
        if found and found[-1][1]["batch"] == before:
            found = found[:-1]
        if not found:
            return None
        return self._rows(found[-1][1], None if keys is None else self._touched(keys))

    def missing(self, keys: DataFrame, before: str | None = None, where: str = "true") -> DataFrame:
        """The rows of `keys` whose bucket columns name no row of the table (of those that `where` describes)."""
        stored = self.read(keys, before)
        stored = stored if stored is None else stored.where(where)
        return keys if stored is None else keys.join(stored.select(*self.by), self.by, "left_anti")

    # ---- writing -----------------------------------------------------------------------------------

    def merge(self, updates: DataFrame, batch: str, scope: list[str] | None = None, newest: list[str] | None = None, replaced: DataFrame | None = None) -> None:
        """Bring updates in. Rows of the same `scope` (the bucket columns and any more) are replaced; with `newest`, the row
        with the largest of these columns stays, old or new. `replaced`: scopes whose old rows go though no new ones come."""
        scope = list(scope or self.by)
        if not set(self.by) <= set(scope):
            raise ValueError("rows of one scope must lie in one bucket")
        updates = cut(updates)
        old_scopes = updates.select(*scope) if replaced is None else updates.select(*scope).unionByName(replaced.select(*scope))
        old_scopes = cut(old_scopes.distinct())

        def state(stored: DataFrame | None) -> DataFrame:
            if newest:
                both = updates if stored is None else stored.unionByName(updates, allowMissingColumns=True)
                rest = [c for c in both.columns if c not in scope]
                return both.groupBy(*scope).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row")).select(*scope, "_row.*").select(*both.columns)
            return updates if stored is None else stored.join(old_scopes, scope, "left_anti").unionByName(updates, allowMissingColumns=True)

        self._replace(old_scopes, batch, state)

    def delete(self, scopes: DataFrame, batch: str, scope: list[str] | None = None) -> None:
        """Rows of these scopes go; buckets that hold none of them keep their files."""
        scope = list(scope or self.by)
        self._replace(cut(scopes.select(*scope).distinct()), batch, lambda stored: None if stored is None else stored.join(scopes.select(*scope).distinct(), scope, "left_anti"), only_matching=scope)

    def _replace(self, scopes: DataFrame, batch: str, state, only_matching: list[str] | None = None) -> None:
        found = self._manifests()
        again = bool(found) and found[-1][1]["batch"] == batch
        base = found[:-1] if again else found
        number = found[-1][0] if again else (found[-1][0] + 1 if found else 0)
        manifest = base[-1][1] if base else None
        touched = self._touched(scopes)
        stored = self._rows(manifest, touched) if manifest else None
        if only_matching and stored is not None:
            # Only buckets that do hold such a row are written anew.
            touched = self._touched(stored.join(scopes, only_matching, "left_semi"))
            stored = self._rows(manifest, touched)
        result = state(stored) if touched else None
        folders = dict(manifest["folders"]) if manifest else {}
        schema = manifest["schema"] if manifest else None
        if result is not None:
            column = next(c for c in ["_bucket", *(f"_bucket{i}" for i in range(len(result.columns) + 1))] if c not in result.columns)
            version = f"v{number:012d}"
            rows = result.withColumn(column, self._numbered())
            # Brought together by bucket; large ones are split by size.
            rows.hint("rebalance", column).write.mode("overwrite").partitionBy(column).option("partitionOverwriteMode", "static").parquet(f"{self.path}/{version}")
            written = {f.getPath().getName() for f in self._fs.listStatus(self._at(version)) if "=" in f.getPath().getName()}
            for b in touched:
                folders.pop(str(b), None)
                if f"{column}={b}" in written:
                    folders[str(b)] = f"{version}/{column}={b}"
            schema = result.schema.jsonValue()
        if schema is None:
            return
        self._publish(number, {"batch": batch, "count": self.buckets, "folders": folders, "schema": schema})
        self._tidy()


class KeyedStore:
    """The result tables of all batches, a KeyedTable each; the run table is the ledger of exports that are done."""

    def __init__(self, spark: SparkSession, out: str, buckets: int = 64) -> None:
        self.spark, self.out, self.buckets = spark, out.rstrip("/"), buckets

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.out}/{name}", KEYS, self.buckets)

    def unknown(self, exports: DataFrame, batch: str | None = None, where: str = "true") -> DataFrame:
        """Exports not done before this batch. Only the ledger's buckets that these can lie in are read, and of those two columns."""
        return self.table("run").missing(exports, batch, where)

    def write(self, tables: dict[str, DataFrame], batch: str) -> None:
        """All tables of a batch, the run table last. Exports of the batch are replaced in every table, also where they have no rows."""
        done = cut(tables["run"].select(*KEYS).distinct())
        for name in sorted(tables, key=lambda n: n == "run"):
            self.table(name).merge(tables[name], batch, replaced=done)

    def erase(self, erased: DataFrame, batch: str, at: str) -> None:
        """Everything derived from the exports (tenant_id, export_id) goes from every table but `audit`, which gains a row for each.
        Files of buckets without such a row stay as they are. Erasing again changes nothing."""
        names = [n for n in ("card", "coverage", "finding", "issue", "outcome", "packet", "profile", "record", "rejection", "rejection_sample", "run")]
        erased = cut(erased.select(*KEYS).distinct())
        audit = self.table("audit")
        known = self.table("run").read(erased)
        held = erased if known is None else erased.join(known.select(*KEYS), KEYS, "left_semi")
        audit.merge(audit.missing(held).select(*KEYS, F.lit("erased").alias("event"), F.lit(at).alias("at")), batch)
        for name in names:
            table = self.table(name)
            if table.read() is not None:
                table.delete(erased, batch)

"""The service's operations on tables in one folder: files, states, chunks and a graph.

States are partial updates that are only ever appended; what is asked for is
always derived from the tables, so that nothing else has to be kept in step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions import text as T
from .operators import entity as E
from .operators import graph as G
from .operators import retrieval as R
from .operators import state as S
from .sources import tables as X

UPDATE = "filename string, at string, n long, task_id string, status string, uploaded_at string, completed_at string, error string"
BLOB = "mime string, size long, content binary, filename string"
CHUNK = "source string, chunk_id string, section string, period string, type string, page int, page_end int, page_range string, text string, point_id string"
NODE = "type string, name string, created_by string, document_id string"
EDGE = "src string, type string, dst string, document_id string"
TYPES = ["Person", "Organization", "Location", "Technology", "Product", "Event", "Concept", "Document", "Law", "Date", "Amount"]


class Refused(Exception):
    """A request that isn't carried out, with the status it is answered with."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


class Service:
    """All operations; ``root`` is a folder that the driver and all executors share.

    ``generate`` makes an answer from question and context, ``extract`` nodes
    and edges from chunks (document_id, chunk_id, text): stubs by default.
    """

    def __init__(self, spark: SparkSession, root: str, generate: Callable[[Column, Column], Column] = models.stub_answer, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = models.stub_extraction):
        self.spark, self.root, self.generate, self.extract, self.written = spark, root.rstrip("/"), generate, extract, 0

    def _table(self, name: str, schema: str) -> DataFrame:
        """The table as it is now, empty where there is none yet."""
        path = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _replace(self, name: str, schema: str, filename: str, new: DataFrame | None, column: str) -> None:
        """The rows of one document replaced: a folder for each, so that no other is read or written."""
        rows = new if new is not None else self.spark.createDataFrame([], schema)
        rows = rows.select(*[F.col(f.name) for f in self._table(name, schema).schema if f.name != column], F.lit(filename).alias(column))
        path = f"{self.root}/{name}"
        if rows.isEmpty():
            self._drop(path, column, filename)
        else:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)

    def _drop(self, path: str, column: str, value: str) -> None:
        """Overwrites the document's folder with no row; other documents' folders aren't touched."""
        held = self._table(path.rpartition("/")[2], {"blobs": BLOB, "chunks": CHUNK, "nodes": NODE, "edges": EDGE}[path.rpartition("/")[2]])
        if not held.where(F.col(column) == value).isEmpty():
            one = held.where(F.lit(False)).drop(column)
            one.write.mode("overwrite").parquet(f"{path}/{column}={value}")

    def _write_state(self, filename: str, **fields: str) -> None:
        self.written += 1
        row = {"filename": filename, "n": self.written, **{k: fields.get(k) for k in ("task_id", "status", "uploaded_at", "completed_at", "error")}}
        now = T.utc_now()
        df = self.spark.createDataFrame([row], "filename string, n long, task_id string, status string, uploaded_at string, completed_at string, error string").withColumn("at", now)
        stamp = lambda c: F.when(F.col(c) == "now", now).otherwise(F.col(c))
        df.withColumn("uploaded_at", stamp("uploaded_at")).withColumn("completed_at", stamp("completed_at")).write.mode("append").parquet(f"{self.root}/updates")

    def states(self) -> DataFrame:
        return S.fields(self._table("updates", UPDATE), "filename", ["at", "n"]).where("status <> 'deleted'")

    def upload(self, filename: str, content: bytes) -> None:
        """Stores a file and notes that it is processed; refuses other kinds (400) and names that are taken (409)."""
        row = self.spark.createDataFrame([(filename, bytearray(content))], "filename string, content binary")
        if row.where(T.is_upload(F.col("filename"))).isEmpty():
            raise Refused(400, f"files like {filename} aren't taken")
        if not self._table("blobs", BLOB).where(F.col("filename") == filename).isEmpty():
            raise Refused(409, f"{filename} is there already")
        X.write_blobs(row, f"{self.root}/blobs")
        self._write_state(filename, status="processing", task_id=f"task-{filename}", uploaded_at="now", completed_at="", error="")

    def ingest(self, filename: str) -> str:
        """Chunks and graph of a stored file in place of what there was; its end state. Running it again changes nothing."""
        if self.status(filename).get("status") == "cancelled":
            return self._clean(filename, "cancelled")
        blob = self._table("blobs", BLOB).where(F.col("filename") == filename)
        try:
            chunks = X.parse_files(blob).withColumn("point_id", T.point_id(F.col("source"), F.col("text"))).dropDuplicates(["point_id"])
            self._replace("chunks", CHUNK, filename, chunks, "source")
            held = self._table("chunks", CHUNK).where(F.col("source") == filename)
            nodes, edges = self.extract(held.select(F.col("source").alias("document_id"), "chunk_id", "text"))
            nodes, edges = G.validate(nodes, edges, TYPES)
            kept = G.upsert_nodes(nodes)
            named = G.local_edges(nodes, edges).withColumn("document_id", F.lit(filename))
            self._replace("nodes", NODE, filename, kept, "document_id")
            self._replace("edges", EDGE, filename, G.upsert_edges(named, kept), "document_id")
        except Exception as e:  # noqa: BLE001  whatever a file does to its parser
            self._write_state(filename, status="failed", completed_at="now", error=str(e)[:500])
            return "failed"
        if self.status(filename).get("status") == "cancelled":
            return self._clean(filename, "cancelled")
        self._write_state(filename, status="completed", completed_at="now")
        return "completed"

    def _clean(self, filename: str, state: str) -> str:
        for name, column in (("chunks", "source"), ("nodes", "document_id"), ("edges", "document_id")):
            self._drop(f"{self.root}/{name}", column, filename)
        return state

    def status(self, filename: str) -> dict:
        found = self.states().where(F.col("filename") == filename).first()
        return found.asDict() if found else {}

    def cancel(self, filename: str) -> None:
        self._write_state(filename, status="cancelled", completed_at="now")

    def delete(self, filename: str) -> dict:
        """What was done to the document's chunks and graph, its file, and its state."""
        steps = {"memory": "deleted", "storage": "deleted", "state": "cleared"}
        try:
            self._clean(filename, "")
        except Exception as e:  # noqa: BLE001
            steps["memory"] = f"failed: {e}"
        if self._table("blobs", BLOB).where(F.col("filename") == filename).isEmpty():
            steps["storage"] = "not_found"
        else:
            self._drop(f"{self.root}/blobs", "filename", filename)
        self._write_state(filename, status="deleted")
        return steps

    def blob(self, filename: str) -> DataFrame:
        found = X.read_blob(self.spark, f"{self.root}/blobs", filename)
        if found.isEmpty():
            raise Refused(404, f"there is no {filename}")
        return found

    def documents(self) -> DataFrame:
        return S.listing(self._table("blobs", BLOB).select("filename", "size"), self.states())

    def graph(self, limit: int = 1000) -> DataFrame:
        return G.viz(self._table("edges", EDGE), limit)

    def dashboard(self) -> DataFrame:
        """One row: documents, their size, how many are processed, nodes, edges, the six names with most edges, edge types."""
        docs, edges = self.documents(), self._table("edges", EDGE)
        one = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count_if(F.col("status") == "processing").alias("processing"))
        size = edges.agg(F.count("*").alias("edges")).join(F.broadcast(G.degrees(edges).agg(F.count("*").alias("nodes"))))
        names = G.top_degree(edges, 6).agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("less"), "name"))).alias("t")).select(F.transform("t", lambda x: x["name"]).alias("top_names"))
        kinds = G.relation_histogram(edges).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relations"))
        return one.join(F.broadcast(size)).join(F.broadcast(names)).join(F.broadcast(kinds))  # one row each

    def query(self, question: str, selected: list[str] | None = None) -> DataFrame:
        """Answer, sources, confidence and the context that was used; refuses what is no question (422)."""
        asked = self.spark.createDataFrame([(0, question)], "item_id long, raw string").select("item_id", T.valid_question(F.col("raw")).alias("text"))
        if asked.where("text IS NOT NULL").isEmpty():
            raise Refused(422, "a question has 3 to 2,000 characters")
        chunks = self._table("chunks", CHUNK).withColumn("doc_id", F.xxhash64("point_id"))
        hits = R.sparse_topk(asked, chunks, 10, filters={"source": selected or []}).join(chunks.select("doc_id", "source", "section", "page", "text"), "doc_id")
        ranked = R.rerank(hits.withColumn("s", (F.col("shared") - 5).cast("double")).withColumnRenamed("rank", "prior"), "item_id", "s", "prior", -5.0)
        lines = ranked.withColumn("line", T.context_line(F.col("source"), F.col("section"), F.col("page"), F.col("s"), F.col("text")))
        got = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("context_used"), F.array_sort(F.collect_set(F.concat_ws(":Pg", "source", F.col("page").cast("string")))).alias("sources"), F.coalesce(F.max("s"), F.lit(0.0)).alias("best"))
        context = F.array_join("context_used", "\n\n")
        done = got.withColumn("answer", T.strip_system_note(T.strip_thinking(self.generate(F.lit(question), context))))
        return done.select("answer", "context_used", "sources", T.confidence(F.col("best"), F.lit(False), F.lit(False)).alias("confidence"))

    def summarize(self, filename: str) -> DataFrame:
        return self.query(f"Summarize the main points of {filename}", [filename])

    def health(self) -> DataFrame:
        """Whether each table can be read."""
        rows = []
        for name, schema in (("blobs", BLOB), ("chunks", CHUNK), ("edges", EDGE), ("nodes", NODE), ("updates", UPDATE)):
            try:
                self._table(name, schema).limit(1).count()
                rows.append((name, "ok"))
            except Exception as e:  # noqa: BLE001
                rows.append((name, f"error: {str(e)[:60]}"))
        return S.health(self.spark.createDataFrame(rows, "service string, result string"))

    def resolve_names(self, nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Graphs of chunks after fuzzy clusters of their names (document, name, person): clusters that are sure are merged."""
        clusters = E.leader_clusters(names, "document", "person").where("method = 'auto'").select("name", "canonical")
        return E.apply_registry(nodes, edges, clusters.groupBy("name").agg(F.max("canonical").alias("canonical")), ["Person", "Organization"])

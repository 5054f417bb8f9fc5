"""A workspace: casefiles, their documents and all that derives from them, in snapshots.

Tables lie in Parquet folders by casefile. A change writes new folders of the
casefiles that it touches and then adds one manifest that names all folders in
force, so readers see all of a change or nothing, and a change that fails
leaves what was there. Manifests are numbered, and a number is given once: of
two writers the second sees the first one's manifest, adds its change to that
if they touch different tables or casefiles, and else is told of the conflict.
Documents that are new to a casefile add folders; only what replaces rows writes
the casefile's tables anew. Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from caseweave import schemas
from caseweave.config import Profile, parse
from caseweave.errors import ConfigError, ConflictError, NotFoundError, ValidationError
from caseweave.functions import models
from caseweave.functions.embedding import Embedder, HashEmbedder, embed
from caseweave.functions.enrich import Reranker, Summariser, fold_summary, summarise
from caseweave.identity import Contract, verify
from caseweave.operators import corpus, coverage, evaluate, facets, pages, records, search, tree, windows
from caseweave.plans.durable import scratch
from caseweave.sources import ingest as files
from caseweave.sources import readers

SLUG = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")
MANIFEST = re.compile(r"manifest-([0-9]{12})\.json")
#: Folders of a table of a casefile from which on its next change writes them as one.
FOLDERS_MOST = 32

#: Folders by table and casefile ("" for tables of the whole store).
Folders = dict[str, dict[str, list[str]]]


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


class Workspace:
    """All of a store at a path. ``embedder`` must have the contract's name and width."""

    def __init__(self, spark: SparkSession, path: str, contract: Contract | None = None, embedder: Embedder | None = None, summariser: Summariser | None = None, reranker: Reranker | None = None) -> None:
        self.spark, self.path, self.contract = spark, path.rstrip("/"), contract or Contract()
        self.embedder = embedder or HashEmbedder(self.contract.dimensions)
        self.summariser, self.reranker = summariser, reranker
        if (self.embedder.name, self.embedder.dimensions) != (self.contract.embedder, self.contract.dimensions):
            raise ConfigError(f"the embedder is {self.embedder.name} of {self.embedder.dimensions}, the contract says {self.contract.embedder} of {self.contract.dimensions}")
        if (summariser.name if summariser else "") != self.contract.summariser:
            raise ConfigError(f"the summariser is {summariser.name if summariser else 'none'}, the contract says {self.contract.summariser or 'none'}")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._migrate()
        meta = {r.key: r.value for r in self.table("store_meta").collect()}
        verify(meta.get("identity"), self.contract)
        if meta and int(meta.get("schema_version", "0")) != schemas.VERSION:
            raise ConfigError(f"the store has tables of version {meta.get('schema_version')}, this is version {schemas.VERSION}")
        if not meta:
            self._commit({("store_meta", ""): self._meta(self.contract.identity())})

    def _meta(self, identity: str) -> DataFrame:
        return self.spark.createDataFrame([("identity", identity), ("schema_version", str(schemas.VERSION))], schemas.SCHEMAS["store_meta"])

    # --- snapshots

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, Folders]:
        """(number, folders in force) of the latest manifest."""
        if not self._fs.exists(self._at("")):
            return 0, {}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        latest = max((int(m[1]) for n in names if (m := MANIFEST.fullmatch(n))), default=0)
        return latest, json.loads(self._text(f"manifest-{latest:012d}.json")) if latest else {}

    def _read(self, folders: Folders, name: str, casefile: str | None = None) -> DataFrame:
        own = folders.get(name, {})
        paths = [f"{self.path}/{p}" for c in ([casefile] if casefile is not None else sorted(own)) for p in own.get(c, [])]
        if not paths:
            return self.spark.createDataFrame([], schemas.SCHEMAS[name])
        return self.spark.read.schema(schemas.SCHEMAS[name]).parquet(*paths)

    def table(self, name: str, casefile: str | None = None) -> DataFrame:
        """A table, whole or of one casefile (by id), of which no other folder is read."""
        return self._read(self._manifest()[1], name, casefile)

    def _commit(self, put: dict[tuple[str, str], DataFrame | None], add: dict[tuple[str, str], DataFrame] | None = None, base: tuple[int, Folders] | None = None) -> None:
        """Write tables of casefiles anew (None: away with them) and add rows to others, all in one manifest.

        ``base`` is the manifest that the change was made from.
        """
        number, before = base or self._manifest()
        snapshot, written = f"snapshot-{uuid.uuid4().hex}", {}
        for (name, casefile), df in [*put.items(), *(add or {}).items()]:
            if df is not None:
                columns = self.spark.createDataFrame([], schemas.SCHEMAS[name]).columns
                written[name, casefile] = f"{snapshot}/{name}-{casefile or 'all'}"
                df.select(*columns).write.parquet(f"{self.path}/{written[name, casefile]}")
        self._fs.mkdirs(self._at(""))
        while True:
            latest, folders = self._manifest()
            for name, casefile in [*put, *(add or {})]:
                if latest != number and folders.get(name, {}).get(casefile) != before.get(name, {}).get(casefile):
                    raise ConflictError(f"{name} was changed by another writer meanwhile")
            for key in put:
                folders.setdefault(key[0], {}).pop(key[1], None)
                if key in written:
                    folders[key[0]][key[1]] = [written[key]]
            for key in add or {}:
                folders.setdefault(key[0], {}).setdefault(key[1], []).append(written[key])
            if self._publish(latest + 1, folders):
                return

    def _publish(self, number: int, folders: Folders) -> bool:
        """Add the manifest of that number, if there is none yet."""
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        conf, context = self.spark._jsc.hadoopConfiguration(), self._jvm.org.apache.hadoop.fs.FileContext
        context = context.getFileContext(draft.toUri(), conf) if "://" in self.path else context.getFileContext(conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = self._at(f"manifest-{number:012d}.json")
        try:
            context.rename(draft, target, options)
            return True
        except Exception:
            self._fs.delete(draft, False)
            if not self._fs.exists(target):
                raise
            return False

    def vacuum(self, keep: int = 8) -> int:
        """Delete folders that none of the last ``keep`` manifests names, and older manifests; how many folders went."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        manifests = sorted(n for n in names if MANIFEST.fullmatch(n))
        used = {p.split("/")[0] for n in manifests[-keep:] for own in json.loads(self._text(n)).values() for paths in own.values() for p in paths}
        gone = [n for n in names if n.startswith("snapshot-") and n not in used]
        for n in [*gone, *manifests[:-keep]]:
            self._fs.delete(self._at(n), True)
        return len(gone)

    def _migrate(self) -> None:
        """Bring a store of an older version up to date, step by step; each step is one commit, and what was there stays until then."""
        latest, _ = self._manifest()
        if latest or not self._fs.exists(self._at("manifest.json")):
            return
        # version 1: one manifest, a folder for each table, no postings
        old = json.loads(self._text("manifest.json"))
        read = lambda name: self.spark.read.schema(schemas.SCHEMAS[name]).parquet(f"{self.path}/{old[name]}") if name in old else self.spark.createDataFrame([], schemas.SCHEMAS[name])
        identity = {r.key: r.value for r in read("store_meta").collect()}.get("identity", "")
        put = {("store_meta", ""): self._meta(identity), ("casefiles", ""): read("casefiles")}
        for case in read("casefiles").collect():
            mine = {n: read(n).filter(F.col("casefile_id") == case.id) for n in ("documents", "chunks", "mentions", "ingest_runs")}
            mine["document_places"] = read("document_places").join(mine["documents"].select(F.col("id").alias("document_id")), "document_id", "left_semi")
            mine["chunk_vectors"] = read("chunk_vectors").join(mine["chunks"].select("chunk_id"), "chunk_id", "left_semi")
            put |= {(n, case.id): df for n, df in (mine | self._searchable(mine["chunks"])).items()}
        self._commit(put)

    @staticmethod
    def _searchable(chunks: DataFrame) -> dict[str, DataFrame]:
        """What search reads of passages: themselves in order of their documents, their postings and statistics."""
        return {"chunks": chunks.repartitionByRange("document_id", "ordinal").sortWithinPartitions("document_id", "ordinal"), "postings": corpus.stored_postings(chunks), "passage_statistics": corpus.passage_statistics(chunks)}

    # --- casefiles

    def casefiles(self) -> DataFrame:
        return pages.casefile_listing(self.table("casefiles"))

    def casefile(self, reference: str) -> Row:
        return pages.resolve(self.table("casefiles"), reference, slug="slug")

    def create_casefile(self, title: str, slug: str = "", description: str = "") -> Row:
        slug = slug or re.sub("[^a-z0-9]+", "-", title.lower()).strip("-")[:64].rstrip("-")
        self._check(title, slug, description)
        base = self._manifest()
        if self._read(base[1], "casefiles").filter(F.col("slug") == slug).limit(1).count():
            raise ConflictError(f"a casefile is named {slug!r} already")
        row = self.spark.createDataFrame([(uuid.uuid4().hex, slug, title, description, now(), now())], "id string, slug string, title string, description string, c string, u string")
        row = row.select("id", "slug", "title", "description", F.to_timestamp("c").alias("created_at"), F.to_timestamp("u").alias("updated_at"))
        self._commit({}, {("casefiles", ""): row}, base)
        return self.casefile(slug)

    def update_casefile(self, reference: str, **changes: str) -> Row:
        base, old = self._manifest(), self.casefile(reference)
        new = old.asDict() | changes
        self._check(new["title"], new["slug"], new["description"])
        if self.table("casefiles").filter((F.col("slug") == new["slug"]) & (F.col("id") != old.id)).limit(1).count():
            raise ConflictError(f"a casefile is named {new['slug']!r} already")
        mine = F.col("id") == old.id
        put = {c: F.when(mine, F.lit(new[c])).otherwise(F.col(c)) for c in ("slug", "title", "description")}
        rows = self._read(base[1], "casefiles").withColumns(put | {"updated_at": F.when(mine, F.to_timestamp(F.lit(now()))).otherwise(F.col("updated_at"))})
        self._commit({("casefiles", ""): rows}, base=base)
        return self.casefile(old.id)

    @staticmethod
    def _check(title: str, slug: str, description: str) -> None:
        if not 1 <= len(title.strip()) <= 200 or len(description) > 2000 or len(slug) > 64 or not SLUG.fullmatch(slug):
            raise ValidationError("a casefile needs a title of 1 to 200 characters, a description of at most 2000, and a slug of lower-case words joined by hyphens")

    def delete_casefile(self, reference: str) -> Row:
        """The casefile and everything in it."""
        base, gone = self._manifest(), self.casefile(reference)
        own = {(name, gone.id): None for name in schemas.SCHEMAS if name not in schemas.GLOBAL and gone.id in base[1].get(name, {})}
        self._commit(own | {("casefiles", ""): self._read(base[1], "casefiles").filter(F.col("id") != gone.id)}, base=base)
        return gone

    def _without(self, base: Folders, casefile: str, ids: DataFrame) -> dict[str, DataFrame]:
        """Tables of a casefile's documents without the rows of some documents."""
        out = {name: (t := self._read(base, name, casefile)).join(ids, t[column] == ids["id"], "left_anti") for name, column in schemas.OF_DOCUMENT.items()}
        vectors = records.sidecar_without(self._read(base, "chunk_vectors", casefile), self._read(base, "chunks", casefile), ids.toDF("document_id"))
        return out | {"chunk_vectors": vectors, "passage_statistics": corpus.passage_statistics(out["chunks"])}

    def delete_document(self, casefile: str, reference: str) -> Row:
        """A document and all below it, with what derives from them."""
        base, row = self._manifest(), self.document(casefile, reference)
        documents = self._read(base[1], "documents", row.casefile_id)
        below = tree.descendants(documents, row.id).select("id").union(documents.filter(F.col("id") == row.id).select("id")).distinct().cache()
        rest = {"documents": documents.join(below, "id", "left_anti")} | self._without(base[1], row.casefile_id, below)
        self._commit({(name, row.casefile_id): df for name, df in rest.items()}, base=base)
        return row

    # --- ingest

    def ingest(self, casefile: str, root: str) -> Row:
        """Read all files below ``root`` and what they contain into the casefile; the run's record is returned.

        All reading and deriving comes first; one commit then stores documents,
        places, passages, postings, vectors, identifiers and the record of the
        run. Beside the record's own fields the result says how many places were
        ``first`` (of a new document), ``known``, ``new`` and ``unknown``.
        """
        with scratch():
            return self._ingest(casefile, root)

    def _ingest(self, casefile: str, root: str) -> Row:
        base, case, started = self._manifest(), self.casefile(casefile), now()
        old = lambda name: self._read(base[1], name, case.id)
        found, stopped = files.expand(files.scan(self.spark, root))
        incoming = files.documents(found, case.id, started).cache()
        known, columns = old("documents"), old("documents").columns
        seen = files.sightings(found, case.id, root).withColumn("first_seen_at", F.to_timestamp(F.lit(started)))
        labels = {r.label: r["count"] for r in records.label_sightings(seen, old("document_places"), known).groupBy("label").count().collect()}
        texts = incoming.select(F.col("id").alias("document_id"), "casefile_id", F.lit(0).cast("long").alias("doc_id"), F.col("extracted_text").alias("text"))
        chunks = corpus.chunks(texts, self.contract.chunk_max_chars, self.contract.chunk_overlap_chars).withColumn("summary", F.lit(""))
        if self.summariser is not None:
            chunks, incoming = self._summarised(chunks, incoming)
        chunks = chunks.cache()
        wide = F.raise_error(F.lit(f"a vector is not {self.contract.dimensions} wide")).cast("array<float>")
        vectors = chunks.select("chunk_id", embed(fold_summary(F.col("summary"), F.col("text")), self.embedder).alias("embedding"))
        vectors = vectors.withColumn("embedding", F.when(F.size("embedding") == self.contract.dimensions, F.col("embedding")).otherwise(wide))
        made = {"documents": incoming.select(*columns), "document_places": seen, "chunk_vectors": vectors, "mentions": corpus.mentions(chunks), **self._searchable(chunks)}
        count = lambda status: found.filter(F.col("status") == status).count()
        refused = count("refused") + found.agg(F.coalesce(F.sum(F.size("refusals")), F.lit(0))).first()[0]
        overlap = not known.join(incoming.select("id"), "id", "left_semi").isEmpty()
        crowded = any(len(own.get(case.id, [])) >= FOLDERS_MOST for own in base[1].values())
        before, after = known.count(), 0
        put, add = {}, {}
        if overlap or crowded:  # rows are replaced, or folders are many: the casefile's tables are written anew
            kept = self._without(base[1], case.id, incoming.select("id"))
            put = {name: kept[name].unionByName(made[name].select(*kept[name].columns)) for name in ("chunks", "chunk_vectors", "mentions", "postings")}
            put["chunks"] = put["chunks"].repartitionByRange("document_id", "ordinal").sortWithinPartitions("document_id", "ordinal")
            put["postings"] = put["postings"].repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
            put["documents"] = records.upsert_documents(known, made["documents"])
            put["document_places"] = records.merge_places(old("document_places"), seen)
            put["passage_statistics"] = corpus.passage_statistics(put["chunks"])
            after = put["documents"].count()
        else:
            add = made
            after = before + incoming.count()
        run = (uuid.uuid4().hex, case.id, started, now(), before, after, count("ingested"), count("failed"), int(refused), count("skipped"), stopped)
        record = self.spark.createDataFrame([run], schemas.SCHEMAS["ingest_runs"].replace("timestamp", "string")).withColumns({c: F.to_timestamp(c) for c in ("started_at", "finished_at")})
        self._commit({(name, case.id): df for name, df in put.items()}, {(name, case.id): df for name, df in (add | {"ingest_runs": record}).items()}, base)
        return record.select("*", *(F.lit(labels.get(x, 0)).alias(x) for x in ("first", "known", "new", "unknown"))).first()

    def _summarised(self, chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Passages and documents with their summaries; a document's passages are summarised together, in order."""
        summariser = self.summariser

        def work(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("ordinal")
            own, whole = summarise(summariser, rows["whole"].iloc[0], rows["text"].tolist())
            return pd.DataFrame({"chunk_id": rows["chunk_id"], "document_id": rows["document_id"], "of_passage": own, "of_document": whole})

        full = chunks.join(documents.select(F.col("id").alias("document_id"), F.col("extracted_text").alias("whole")), "document_id")
        said = full.select("document_id", "chunk_id", "ordinal", "text", "whole").groupBy("document_id").applyInPandas(work, "chunk_id string, document_id string, of_passage string, of_document string").cache()
        chunks = chunks.join(said.select("chunk_id", "of_passage"), "chunk_id", "left").withColumn("summary", F.coalesce("of_passage", F.lit(""))).drop("of_passage")
        whole = said.groupBy(F.col("document_id").alias("id")).agg(F.first("of_document").alias("of_document"))
        documents = documents.join(whole, "id", "left").withColumn("summary", F.coalesce("of_document", F.lit(""))).withColumn("summary_by", F.when(F.col("summary") != "", summariser.name).otherwise("")).drop("of_document")
        return chunks, documents

    # --- questions

    def document(self, casefile: str, reference: str) -> Row:
        return pages.resolve(self.table("documents", self.casefile(casefile).id), reference)

    def passage(self, casefile: str, reference: str) -> Row:
        case = self.casefile(casefile)
        try:
            return pages.resolve(self.table("chunks", case.id), reference, "chunk_id")
        except NotFoundError:
            if not pages.with_prefix(self.table("chunks"), "chunk_id", reference).limit(1).isEmpty():
                raise NotFoundError(f"passage {reference!r} belongs to another casefile") from None
            raise

    def documents_page(self, casefile: str, parent: str | None = None, expanded: bool = False, offset: int = 0, limit: int = 50) -> pages.Page:
        narrow = self.table("documents", self.casefile(casefile).id).withColumn("characters", F.length("extracted_text")).drop("extracted_text")
        rows, order, _ = pages.select_documents(narrow, parent, expanded)
        return pages.page(rows, order, offset, limit)

    def every_document(self, casefile: str) -> DataFrame:
        """All documents of a casefile in order of listing, without a bound and without their texts."""
        return pages.every_document(self.table("documents", self.casefile(casefile).id).drop("extracted_text"))

    def document_ids(self, casefile: str) -> DataFrame:
        return pages.document_ids(self.table("documents", self.casefile(casefile).id))

    def document_passages(self, casefile: str, reference: str) -> DataFrame:
        """Every passage of a document, by ordinal."""
        row = self.document(casefile, reference)
        return pages.document_passages(self.table("chunks", row.casefile_id), row.id)

    def containment_chain(self, casefile: str, reference: str) -> list[Row]:
        row = self.document(casefile, reference)
        return tree.ancestors(self.table("documents", row.casefile_id), row.id).collect()

    def search(self, casefile: str, query: str, limit: int = 10, mention: str = "", scorer=None) -> DataFrame:
        """Hits in order of ``position``, each with the window around it (window_start, window_end, narrowed, window_text).

        The keyword leg reads the postings of the asked terms; passages and
        documents are read for the hits alone.
        """
        case = self.casefile(casefile)
        own = lambda name: self.table(name, case.id)
        hits = search.hybrid(own("chunks"), case.id, query, self.embedder, limit, mention, own("mentions"), own("chunk_vectors"), scorer or self.reranker, self.table("postings"), self.table("passage_statistics"))
        rows = hits.collect()  # a page
        here = self.spark.createDataFrame(rows, hits.schema)
        if not rows:
            return here.selectExpr("*", "cast(null as long) window_start", "cast(null as long) window_end", "false narrowed", "cast(null as string) window_text")
        ids = sorted({r.document_id for r in rows})
        texts = own("documents").filter(F.col("id").isin(*ids)).select(F.col("id").alias("document_id"), F.col("extracted_text").alias("text"))
        found = windows.result_windows(here.select(F.lit(1).alias("query_id"), "position", "chunk_id"), own("chunks").filter(F.col("document_id").isin(*ids)), texts)
        return here.join(found.drop("query_id", "position"), "chunk_id", "left")

    def measure(self, casefile: str, judgements: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame, dict]:
        """(metrics of the keyword, vector and fused legs; of the fused one by language; conditions) of a set of judgements.

        Each query of the set goes through the search itself.
        """
        case, parts, ranked_by = self.casefile(casefile), [], set()
        chunks, vectors = self.table("chunks", case.id), self.table("chunk_vectors", case.id)
        names = self.table("documents", case.id).select(F.col("id").alias("document_id"), "filename")
        for q in judgements.select("query_id", "query").distinct().orderBy("query_id").collect():
            terms, target = search.query_terms(self.spark, q.query), self.embedder.query(q.query).tolist()
            keyword = search.postings_leg(self.table("postings"), self.table("passage_statistics"), chunks, case.id, terms, limit).select("chunk_id", F.col("keyword_rank").alias("rank"), F.lit("keyword").alias("leg"))
            vector = search.vector_leg(vectors, target, limit, "chunk_id").select("chunk_id", F.col("vector_rank").alias("rank"), F.lit("vector").alias("leg"))
            fused = self.search(casefile, q.query, limit)
            ranked_by |= {r.ranking for r in fused.select("ranking").distinct().collect()}
            fused = fused.select("chunk_id", F.col("position").alias("rank"), F.lit("fused").alias("leg"))
            parts.append(reduce(DataFrame.unionByName, (keyword, vector, fused)).withColumn("query_id", F.lit(q.query_id)))
        answers = reduce(DataFrame.unionByName, parts).join(chunks.select("chunk_id", "document_id", "text"), "chunk_id").join(names, "document_id").cache()
        legs, languages = evaluate.by_leg_and_language(answers, judgements)
        conditions = {"identity": self.contract.identity(), "limit": limit, "reranker": self.reranker.name if self.reranker else "", "ranked_by": ", ".join(sorted(ranked_by)) or "no results"}
        return legs, languages, conditions

    def mentions(self, casefile: str, kind: str = "", limit: int = 50) -> DataFrame:
        case = self.casefile(casefile)
        return facets.facets(self.table("mentions", case.id), case.id, kind, limit)

    def mention_documents(self, casefile: str, mention: str, offset: int = 0, limit: int = 50) -> pages.Page:
        case = self.casefile(casefile)
        docs = self.table("documents", case.id).select(F.col("id").alias("document_id"), "casefile_id", "filename", "containment_path", "created_at")
        return facets.carriers_page(self.table("mentions", case.id), docs, case.id, mention, offset, limit, ("containment_path", "created_at", "document_id"))

    def statistics(self, casefile: str) -> Row:
        case = self.casefile(casefile)
        rows = coverage.statistics(self.table("documents", case.id).withColumnRenamed("extracted_text", "text")).collect()
        return rows[0] if rows else Row(casefile_id=case.id, documents=0, documents_ingested=0, documents_expanded=0, characters=0)

    def coverage(self, casefile: str) -> Row:
        case = self.casefile(casefile)
        return coverage.verdicts(self.table("casefiles").filter(F.col("id") == case.id).select(F.col("id").alias("casefile_id")), self.table("ingest_runs", case.id)).first()

    def locations(self, casefile: str, reference: str, limit: int = 20) -> list[Row]:
        row = self.document(casefile, reference)
        return self.table("document_places", row.casefile_id).filter(F.col("document_id") == row.id).orderBy("first_seen_at", "location_path").limit(limit).collect()

    def location_record(self, casefile: str, reference: str, limit: int = 20) -> dict:
        """The places of a document, earliest first, as many as a page; how many there are; and a note where the record is not whole."""
        row = self.document(casefile, reference)
        places = self.table("document_places", row.casefile_id).filter(F.col("document_id") == row.id)
        total, oldest = places.agg(F.count(F.lit(1)), F.min("first_seen_at")).first()
        whole = oldest is not None and oldest <= row.created_at
        note = "" if whole else "the record of places begins after the document was stored, so there may have been others"
        return {"locations": [r.location_path for r in places.orderBy("first_seen_at", "location_path").limit(limit).collect()], "total": total, "truncated": total > limit, "whole": whole, "note": note}

    def repair_mention_offsets(self, casefile: str) -> Row:
        """Put right the offsets of a casefile's mentions; passages whose text is gone are counted, not guessed."""
        base, case = self._manifest(), self.casefile(casefile)
        of = lambda name: self._read(base[1], name, case.id)
        fixed, counts = records.repair_offsets(of("mentions"), of("chunks"), of("documents").select(F.col("id").alias("document_id"), F.col("extracted_text").alias("text")))
        result = counts.first()
        self._commit({("mentions", case.id): fixed}, base=base)
        return result


def open_workspace(spark: SparkSession, configuration: str, env: dict[str, str] | None = None, path: str = "") -> tuple[Workspace, Profile]:
    """(workspace, profile) of a configuration's text: models are chosen and checked against the contract before the store is touched."""
    contract, profile = parse(configuration, env)
    embedder, reranker = models.build_embedder(contract, profile.embed_model), models.build_reranker(profile.rerank_model)
    summariser = models.build_summariser(contract, profile.summary_url, profile.summary_concurrency)
    readers.FLOOR = profile.quality_floor
    return Workspace(spark, path or profile.store, contract, embedder, summariser, reranker), profile

"""A repository and its records as one object: what people ask of a history, each answer a DataFrame.

History comes from git, intent from notes (`refs/notes/intent`), and the change map, sessions and the chunk index are versioned
tables under a folder of the workspace. Reads write nothing; `adopt`, `annotate`, `relink`, `reindex` and `sync` write.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import change_id as normal_id
from ..functions.text import instant_ms
from ..operators import audit, details, embedding, identity, index, ledger, rebuild, touches
from ..operators.chunking import CHUNK_SCHEMA, INDEX_CHARS, chunk_files
from ..operators.keyword import KeywordIndex
from ..operators.retrieval import position_boost
from ..sources import git, git_sink
from ..sources.versioned import VersionedTable
from ..streaming import capture
from ..workspace import cut
from . import ask as asking
from . import export, report, tools
from . import sync as syncing

ENTRY = f"change_id string, revision string, created_at string, author {schemas.AUTHOR}, scope array<struct<path:string,range:array<int>,blob:string>>, summary string, reasoning {schemas.REASONING}, session_ref string, session_refs array<string>, provenance string, folded_into string, redaction_note string"
INDEX = CHUNK_SCHEMA + ", change_id string, session_ref string, embedding array<double>"
DIM = 64
FINGERPRINT, STATE_SCHEMA = f"bag-of-words/{DIM}", "index-state@1"
STATE = "schema string, mode string, last_indexed_commit string, model_fingerprint string, chunk_count bigint, updated_at string"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class TargetError(ValueError):
    pass


class Workspace:
    def __init__(self, spark: SparkSession, repo: str, store: str):
        self.spark, self.repo = spark, repo
        self.map_table, self.session_table, self.index_table, self.state_table = (VersionedTable(spark, f"{store.rstrip('/')}/{n}") for n in ("change_map", "sessions", "index", "index_state"))
        self.keywords = KeywordIndex(spark, f"{store.rstrip('/')}/keywords")

    def git(self, table: str, **options: str) -> DataFrame:
        return git.read(self.spark, self.repo, table, **options)

    def _stored(self, table: VersionedTable, schema: str) -> DataFrame:
        got = table.read()
        return self.spark.createDataFrame([], schema) if got is None else got

    # -- relations

    def commits(self, **options: str) -> DataFrame:
        return self.git("commits", **options)

    def change_map(self) -> DataFrame:
        return self._stored(self.map_table, schemas.CHANGE_MAP)

    def sessions(self) -> DataFrame:
        return self._stored(self.session_table, schemas.SESSIONS)

    def notes(self) -> tuple[DataFrame, DataFrame]:
        """(entries, unreadable notes). Entries: sha, position, digest and the entry's fields; a note's entries oldest first."""
        rows, bad = ledger.parse_notes(self.git("notes"))
        e = rows.select("sha", "position", "digest", F.from_json("entry", ENTRY).alias("e")).select("sha", "position", "digest", "e.*")
        span = lambda s: F.when(F.size(s["range"]) == 2, F.struct(s["range"][0].alias("start_line"), s["range"][1].alias("end_line")))
        return e.withColumn("scope", F.transform("scope", lambda s: F.struct(s["path"].alias("path"), span(s).alias("range"), s["blob"].alias("blob")))), bad

    def owners(self) -> DataFrame:
        """sha and change_id: by the map, else by a trailer; what neither knows is left out."""
        r = identity.resolve(self.commits(rev="--all").select("sha", "message"), self.change_map())
        return r.where(F.col("rule") != "R5").select("sha", "change_id")

    def effective(self, by_note: bool = False) -> DataFrame:
        """The entry that holds of each change (or of each commit's own note)."""
        e, _ = self.notes()
        strength = ledger.strength(F.col("created_at"), F.col("author.human"), F.col("revision"), F.col("digest"))
        key = "sha" if by_note else "change_id"
        if not by_note:
            e = e.dropDuplicates(["change_id", "digest"])
        return ledger.effective(e, key, strength, *[c for c in e.columns if c != key])

    # -- reading

    def timeline(self, **options: str) -> DataFrame:
        e = self.effective(by_note=True)
        e = e.select("sha", F.col("change_id").alias("entry_change_id"), F.col("author.type").alias("kind"), F.col("author.tool").alias("tool"), F.col("author.model").alias("model"), F.col("author.human").alias("human"), F.col("summary").alias("entry_summary"), F.col("reasoning.confidence").alias("entry_confidence"), F.col("provenance").alias("entry_provenance"))
        return report.timeline(self.commits(**options).select("sha", "author_date", "subject", "walk_pos"), e, self.owners().withColumnRenamed("change_id", "mapped_change_id"), self.notes()[1])

    def log(self, **options: str) -> DataFrame:
        return report.log_rows(self.timeline(**options)).orderBy("walk_pos")

    def report(self, **options: str) -> dict[str, DataFrame]:
        rows = self.timeline(**options)
        e = self.effective().select("change_id", "summary", "provenance", F.col("reasoning.confidence").alias("confidence"), "session_ref")
        items = report.attention(rows, e.select("change_id", "summary", "provenance", "confidence"))
        return {"timeline": rows, "changes": report.change_sections(rows, e), "totals": report.totals(rows), "attention": items, "groups": report.attention_groups(items), "warnings": self.notes()[1]}

    def resolve_target(self, target: str) -> str:
        """The change id of `c/<4 to 32 hex digits>` (a beginning must be of one change only) or of a commit."""
        if target.startswith("c/"):
            known = self.change_map().select("change_id").unionByName(self.notes()[0].select("change_id")).distinct()
            found = [r.change_id for r in known.where(F.col("change_id").startswith(target[2:].lower())).limit(2).collect()] if 4 <= len(target) - 2 <= 32 else []
            if len(found) != 1:
                raise TargetError(f"{target}: " + ("no such change" if not found else "several changes"))
            return found[0]
        row = self.owners().where(F.col("sha").startswith(target.lower())).limit(1).collect()
        if not row:
            raise TargetError(f"{target}: no change is known for it")
        return row[0].change_id

    def show(self, target: str) -> DataFrame:
        """All entries of a change in order, numbered, the one that holds marked, each with its session as far as there is one."""
        e = self.notes()[0].where(F.col("change_id") == self.resolve_target(target)).dropDuplicates(["change_id", "digest"])
        strength = ledger.strength(F.col("created_at"), F.col("author.human"), F.col("revision"), F.col("digest"))
        return details.session_info(ledger.numbered(e, "change_id", [instant_ms(F.col("created_at")), F.col("digest")], strength), self.sessions())

    def blame(self, path: str, line: int) -> DataFrame:
        if line < 1:
            raise TargetError("lines count from 1")
        return asking.blame(self.git("blame", file=path), path, line, self.owners(), self.effective().drop("sha"))

    def later_touches(self, path: str, after: str, change_id: str) -> DataFrame:
        folded = self.change_map().select("change_id", F.col("folded_into").alias("into"))
        e = self.effective().join(folded, "change_id", "left").withColumn("folded_into", F.coalesce("folded_into", "into"))
        return asking.later_touches(e, path, after, change_id)

    def ask(self, question: str, path: str | None = None, line: int | None = None, k: int = 8, kinds: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """Sources of an answer by rank. With dates those of the span alone; else the most recent changes are among them. Only an index of the model in use is read."""
        index.check_fingerprint(self.index_state(), FINGERPRINT)
        chunks = self._stored(self.index_table, INDEX)
        boosts = chunks.select("key", position_boost(path, line, F.col("path"), F.col("start_line"), F.col("end_line")).alias("boost")) if path else None
        e = self.effective().select("change_id", F.col("summary").alias("intent"), "created_at", F.to_timestamp("created_at").alias("at"), F.col("session_ref").alias("entry_session_ref"))
        newest = e.join(self.change_map().where(F.col("folded_into").isNotNull()).select("change_id"), "change_id", "left_anti").orderBy(F.desc("at"), "change_id").limit(asking.r.RECENT)
        recent = newest.select(F.concat(F.lit("ledger:"), F.col("change_id")).alias("key"), (-F.col("at").cast("double")).alias("order"))
        how = {"embed": lambda q: embedding.bag_of_words_query(q, DIM), "boosts": boosts, "keywords": self.keywords if self.keywords.rows.version() else None}
        return asking.ask(chunks, e, question, k, kinds, since, until, recent, **how).orderBy("rank")

    def confidence(self, sources: DataFrame, cited: list[int] | None = None, tool_ok: bool = False) -> DataFrame:
        """level and reason for an answer from these sources."""
        return asking.r.confidence(sources, cited, tool_ok)

    def explain_line(self, path: str, line: int, question: str | None = None) -> dict[str, DataFrame]:
        """Why a line is as it is: its commit, change and entry; the entry's session; what touched the file later; and sources found near it."""
        why = self.blame(path, line)
        found = why.select("change_id", "created_at", "summary", "session_ref").limit(1).collect()
        first = found[0] if found else None
        known = first is not None and first.change_id is not None
        later = self.later_touches(path, first.created_at, first.change_id) if known and first.created_at else self.effective().where(F.lit(False))
        asked = question or (first.summary if known and first.summary else f"why {path}")
        return {"line": why, "session": self.sessions().join(why.select("session_ref"), "session_ref", "left_semi"), "later": later, "sources": self.ask(asked, path, line)}

    def index_state(self) -> dict | None:
        """What the last index run recorded; nothing before the first. An unknown schema is an error."""
        got = self.state_table.read()
        state = got.first().asDict() if got is not None else None
        if state and state["schema"] != STATE_SCHEMA:
            raise index.StateError(f"the index state has schema {state['schema']}")
        return state

    def export(self, *targets: str) -> DataFrame:
        """Trace records of all changes, or of those that targets (`c/...`, a commit, a range of commits) name."""
        e = self.effective()
        return export.trace_records(e.join(tools.target_changes(self, list(targets)), "change_id", "left_semi") if targets else e).orderBy("change_id")

    def ask_tools(self) -> list[asking.Tool]:
        """What an answering model may call: see plans.tools."""
        return tools.ask_tools(self)

    def touches(self, depth: int = 5) -> DataFrame:
        """For each change's entry and path how often the path was touched later, and by what first: see operators.touches."""
        folded = self.change_map().select("change_id", F.col("folded_into").alias("into"))
        e = self.effective().join(folded, "change_id", "left").select("change_id", "created_at", "summary", F.coalesce("folded_into", "into").alias("folded_into"), F.transform("scope", lambda s: s["path"]).alias("paths"))
        return touches.later_touches(e, depth)

    def doctor(self) -> DataFrame:
        """name, status, message: what is odd about identities, notes, sessions and the index."""
        m = self.change_map()
        tips = self.git("refs", pattern="refs/heads refs/tags refs/remotes").select(F.col("target").alias("sha"))  # the library's own refs keep no commit alive
        found = audit.identity_findings(m, audit.unreachable_heads(m, audit.reachable(self.commits(rev="--all"), tips)))
        rows = audit.check_rows(found).select("name", "status", "message")
        e, bad = self.notes()
        refs = e.select(F.explode(F.concat(F.array("session_ref"), F.coalesce("session_refs", F.array().cast("array<string>")))).alias("session_ref"))
        def counted(name: str, df: DataFrame) -> DataFrame:
            return df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("name"), F.lit("warn").alias("status"), F.col("n").cast("string").alias("message"))

        rows = rows.unionByName(counted("unreadable notes", bad)).unionByName(counted("missing sessions", audit.dangling(refs, self.sessions(), "session_ref")))
        rows = rows.unionByName(counted("skipped captures", e.where(F.col("redaction_note").isNotNull())))
        legacy = ledger.parse_notes(self.git("notes"))[0].where(F.col("format") == "legacy-envelope").select("sha").distinct()
        return rows.unionByName(counted("legacy notes", legacy)).unionByName(self.verify_index().select(F.concat(F.lit("index "), F.col("problem")).alias("name"), F.lit("warn").alias("status"), F.col("detail").alias("message")))

    # -- writing

    def siblings(self) -> DataFrame:
        """For commits with one parent the unfolded change whose head has the same parent and most of the same paths."""
        c = self.commits(rev="--all").where(F.size("parents") == 1).select("sha", F.col("parents")[0].alias("parent"))
        paths = self.git("paths", rev="--all").groupBy("sha").agg(F.collect_set("path").alias("paths"))
        c = c.join(paths, "sha", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
        live = self.change_map().where(F.col("folded_into").isNull()).select("change_id", "tree_pos", F.col("head").alias("sha"))
        heads = live.join(c, "sha").withColumnRenamed("sha", "head")
        return identity.best_siblings(c, heads)

    def adopt(self, infer: bool = False) -> DataFrame:
        """Writes what trailers and notes say about commits that the map lacks (infer: and what siblings tell); returns what was resolved."""
        commits = self.commits(rev="--all").select("sha", "message", "walk_pos")
        r = identity.resolve(commits, self.change_map(), self.siblings() if infer else None).where(F.col("rule").isin("R1", "R2", "R3", *(["R4"] if infer else [])))
        v = self.map_table.version()
        out = identity.adopt(self.change_map(), r.join(commits.select("sha", "walk_pos"), "sha"), now(), "walk_pos")
        self.map_table.write(out.withColumn("tree_pos", F.coalesce("tree_pos", F.xxhash64("change_id"))), v)
        return r

    def detach(self, sha: str) -> str:
        """Takes a commit from its change; its note, if it has one, gets a change of its own. Returns that change.

        The map is written once, with the commit gone from the one change and in the other; then the note. If a run breaks off between the two, the
        next one finds the commit alone in its change and only mends the note.
        """
        v, m = self.map_table.version(), self.change_map()
        done = m.where((F.col("head") == sha) & (F.size("history") == 1) & (F.col("origin") == "orphan-recovery")).select("change_id").head(1)
        if done:
            own = done[0].change_id
        else:
            own = self.spark.range(1).select(identity.minted()).first()[0]
            row = self.spark.createDataFrame([(own, sha, [sha], False, "orphan-recovery", None, [], [], now(), 0)], schemas.CHANGE_MAP)
            self.map_table.write(identity.detach(m, sha, now()).unionByName(row.select(*m.columns)), v)
        rows = [r.entry for r in ledger.parse_notes(self.git("notes"))[0].where(F.col("sha") == sha).orderBy("position").collect()]  # one note's entries
        if rows:
            lines = [json.dumps({"entry": {**json.loads(x), "change_id": own}, "schema": ledger.LINE_SCHEMA}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in rows]
            git.git(self.repo, "notes", "--ref=intent", "add", "-f", "-m", "\n".join(lines), sha)
        return own

    def annotate(self, target: str, entry: dict) -> str:
        """Adds an entry to a commit's note; the change is the commit's, or a new one. Refuses a note that can't be read and an entry of another change."""
        sha = git.git(self.repo, "rev-parse", "--verify", "--end-of-options", f"{target}^{{commit}}").decode().strip()
        if self.notes()[1].where(F.col("sha") == sha).head(1):
            raise TargetError(f"{sha[:8]}: its note can't be read")
        known = [r.change_id for r in self.owners().where(F.col("sha") == sha).limit(1).collect()]
        own = known[0] if known else self.spark.range(1).select(identity.minted()).first()[0]
        if entry.get("change_id", own) != own:
            raise TargetError("the entry is of another change")
        if "scope" not in entry:  # the files of the commit
            paths = self.git("paths", rev=sha).where(F.col("sha") == sha)
            entry = {**entry, "scope": [{"path": r.path, "blob": r.blob} for r in details.derived_scope(paths).orderBy("path").collect()]}
        full = {"created_at": now(), "provenance": "human-authored", **entry, "change_id": own, "revision": sha}
        line = json.dumps({"entry": full, "schema": ledger.LINE_SCHEMA}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        git.git(self.repo, "notes", "--ref=intent", "append", "-m", line, sha)
        return own

    def record(self, results: DataFrame) -> None:
        """Stores what streaming.capture made of events: sessions first, then each entry as a line of its commit's note. Doing it again adds nothing."""
        kept = cut(results.where(F.col("status") == "captured"))
        self.session_table.insert_new(capture.session_records(kept), "session_ref")
        self.git("notes")  # registers the source
        git_sink.append_notes(self.spark, self.repo, capture.ledger_lines(kept))

    def relink(self, change: str, sha: str) -> None:
        v = self.map_table.version()
        self.map_table.write(identity.relink(self.change_map(), self.spark.range(1).select(normal_id(F.lit(change))).first()[0], sha, now()), v)

    def reindex(self, full: bool = False, since: str | None = None) -> DataFrame:
        """Brings the index to the head and records it; returns counts by kind.

        With a recorded commit (or `since`) that is still there only blobs that changed from it are read and cut, and chunks of
        blobs that no path holds any more go; without one, or with `full`, all are. Ledger and session chunks are always
        swept. Kept vectors are those of rows whose text stays. An index of another model is refused unless it is built in full.
        """
        state = None if full else self.index_state()
        index.check_fingerprint(state, FINGERPRINT)
        head = git.git(self.repo, "rev-parse", "--verify", "HEAD^{commit}").decode().strip()
        wanted = since or (state or {}).get("last_indexed_commit")
        base = git.git(self.repo, "rev-parse", "--verify", "-q", f"{wanted}^{{commit}}", allow=True).decode().strip() if wanted and not full else ""
        old = self._stored(self.index_table, INDEX)
        tree = self.git("tree").select("path", "blob_sha")
        if base:
            before = self.git("tree", rev=base).select("path", "blob_sha")
            code = index.refresh_code(old.where(F.col("kind") == "code").drop("embedding"), before, tree, self.git("blobs", base=base).select("blob_sha", "content").dropDuplicates(["blob_sha"]))
        else:
            code = chunk_files(self.git("blobs"), INDEX_CHARS).dropDuplicates(["key"])
        live = index.ledger_chunks(self.effective(), self.change_map().unionByName(self.effective().select("change_id").join(self.change_map(), "change_id", "left_anti"), allowMissingColumns=True))
        rows = code.unionByName(live, allowMissingColumns=True).unionByName(index.session_chunks(self.sessions(), self._session_owners()), allowMissingColumns=True)
        kept = old.select("key", F.col("text").alias("was"), F.col("embedding").alias("had"))
        rows = rows.drop("reused").join(kept, "key", "left").withColumn("reused", F.col("was").eqNullSafe(F.col("text")) & F.lit(not full))
        rows = rows.withColumn("embedding", F.when(F.col("reused"), F.col("had")).otherwise(embedding.bag_of_words(F.col("text"), DIM))).drop("was", "had")
        # postings go first: if a run breaks off, the next one finds the old index and makes the same changes again
        new, v = cut(rows), self.index_table.version()
        changed, gone = new.where(~F.col("reused")).select("key", "text"), old.select("key").join(new.select("key"), "key", "left_anti")
        self.keywords.update(changed, gone) if base else self.keywords.build(new.select("key", "text"))
        self.index_table.write(new, v)
        mode = "full" if full else "incremental" if base else "initial"
        self.state_table.write(self.spark.createDataFrame([(STATE_SCHEMA, mode, head, FINGERPRINT, new.count(), now())], STATE), self.state_table.version())
        return index.run_counts(new)

    def verify_index(self) -> DataFrame:
        """problem and detail of an index against its record: another model, another count, or behind the head. Rebuilds nothing."""
        state = self.index_state()
        if state is None:
            return self.spark.createDataFrame([("absent", "no index was built")], "problem string, detail string")
        head = git.git(self.repo, "rev-parse", "--verify", "HEAD^{commit}").decode().strip()
        return audit.index_findings(self.state_table.read(), self._stored(self.index_table, INDEX), FINGERPRINT, head)

    def _session_owners(self) -> DataFrame:
        e = self.notes()[0].where(F.col("session_ref").isNotNull())
        return e.select("session_ref", "change_id", instant_ms(F.col("created_at")).alias("change_pos"), F.col("position").alias("entry_pos"))

    def sync(self, other: Workspace, **how) -> DataFrame:
        """Takes in another workspace's sessions, notes and change map, and gives it ours if asked to: see plans.sync."""
        return syncing.sync(self, other, **how)

    def rebuild_map(self, rewrites: DataFrame | None = None) -> DataFrame:
        """Makes the change map anew from trailers, notes and (if they are kept) rewrites, in place of what is stored; returns it."""
        v = self.map_table.version()
        e = self.notes()[0]
        folds = e.where(F.col("folded_into").isNotNull()).select("change_id", "folded_into")
        self.map_table.write(rebuild.rebuilt(self.commits(rev="--all").select("sha", "message", "walk_pos"), now(), e.select("sha", "change_id"), rewrites, folds), v)
        return self.change_map()

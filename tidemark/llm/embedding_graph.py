"""Near duplicates among vectors by navigable small-world graphs, one for each shard of a label.

Vectors of a label and length are dealt to shards by a hash. Each shard is built into a hierarchical graph: layers of nodes with links to near and
spread neighbours. A vector that is nearly equal to a node (cosine of COPY or more) hangs on that node instead of becoming one, so that a group of thousands
of copies is a few nodes. Then every shard is queried with every vector of its label, block by block: beams walk the graph of nodes for all queries of a block in step, and
find the nodes whose members can reach the threshold, by the angles to the node and from the node to its farthest member. Cosines of members and queries
are then computed in double precision and decide alone.

Beams are widened in two ways. A query whose beam is full of such nodes is repeated with twice the width. And queries drawn by position are audited by brute force
against the whole shard: while they miss more than 1 - RECALL of their links, the whole block is repeated with twice the width, up to the number of nodes.

A task holds one shard and one block. What leaves it is a row for each vector with links: their number and the least row that it is connected with there, never a pair
of every link. The number of shards of a label grows with the square root of its rows, so shards and blocks grow alike, until shards have SHARD_ROWS rows.

Defined results: a vector that is null, empty, zero or holds null or non-finite numbers, or whose label is null, has no links and is its own component; so are vectors of unlike
lengths to each other. Rows that repeat an id are vectors of their own and are linked if their vectors are; a null id stays null, is never the component of
others and is not kept. Ties are links. Columns other than the three are not looked at. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, sized, table
from tidemark.llm.near_duplicates import connected

#: A label of n rows has sqrt(n / FIRST_ROWS) shards, or as many more as keep a shard within SHARD_ROWS.
FIRST_ROWS, SHARD_ROWS = 1024, 131_072
#: Neighbours of a node in an upper layer (twice as many in the lowest), width of a beam while building and of the first one while asking.
LINKS, BUILD_WIDTH, WIDTH = 16, 48, 32
#: Upper layers at most; a layer has one in LINKS of the nodes below it.
UPPER = 6
#: From this cosine on a vector hangs on a node.
COPY = 0.98
#: Audited queries of a block, half of them with links where there are so many; the recall that they have to reach.
AUDITED, RECALL = 256, 0.99
#: Queries that walk in step.
STEP = 256
#: Added to angles, so that no rounding hides a node whose members may be links.
_PAD = 1e-9


class Graph:
    """A hierarchical graph over unit vectors, built in blocks. members[i] lists the vectors that hang on node i, itself first."""

    def __init__(self, x, copy: float = COPY, links: int = LINKS, width: int = BUILD_WIDTH):
        import numpy as np

        self.x, self.links = x, links
        self.node = np.zeros(0, "int64")  # the vector of each node
        self.of = np.full(len(x), -1, "int64")  # the node of each vector
        self.near = [np.zeros((0, 2 * links), "int32"), *[np.zeros((0, links), "int32") for _ in range(UPPER)]]
        self.level = np.zeros(0, "int64")
        self.entry, self.top = -1, 0
        for at in range(0, len(x), STEP):
            self._insert(np.arange(at, min(at + STEP, len(x))), copy, width)
        self._finish()

    @classmethod
    def restored(cls, x, of, node, near, entry: int):
        """A graph from its parts: the node of each vector, the vector of each node and the node's neighbours by layer."""
        import numpy as np

        self = cls.__new__(cls)
        self.x, self.of, self.node, self.entry = x, of, node, entry
        self.level = np.array([len(n) - 1 for n in near], "int64")
        self.top = int(self.level[entry])
        self.near = []
        for layer in range(self.top + 1):
            lists = [n[layer] if len(n) > layer else () for n in near]
            table = np.full((len(node), max(1, max(map(len, lists)))), -1, "int32")
            for i, n in enumerate(lists):
                table[i, : len(n)] = n
            self.near.append(table)
        self._finish()
        return self

    def parts(self):
        """For each vector its node, for each node its neighbours by layer."""
        return self.of, [[[int(j) for j in self.near[k][i] if j >= 0] for k in range(int(self.level[i]) + 1)] for i in range(len(self.node))]

    def _finish(self) -> None:
        import numpy as np

        x = self.x
        self.v = x[self.node]
        order = np.argsort(self.of, kind="stable")
        self.members, self.first = order, np.searchsorted(self.of[order], np.arange(len(self.node) + 1))
        cos = np.clip(np.einsum("ij,ij->i", x, self.v[self.of]), -1, 1)
        #: Angle from a node to its farthest member.
        self.radius = np.zeros(len(self.node))
        np.maximum.at(self.radius, self.of, np.where(np.arange(len(x)) == self.node[self.of], 0.0, np.arccos(cos)))

    def _insert(self, block, copy: float, width: int) -> None:
        import numpy as np

        x = self.x[block]
        self.v = self.x[self.node]
        if len(self.node):
            found, cos, _ = self.walk(x, width)
            hangs = cos[:, 0] >= copy
            self.of[block[hangs]] = found[hangs, 0]
        else:
            found, cos, hangs = np.full((len(x), 1), -1), np.full((len(x), 1), -2.0), np.zeros(len(x), bool)
        # Within the block each vector that hangs on no node is a new one, unless it is nearly equal to one before it.
        left = np.nonzero(~hangs)[0]
        within = x[left] @ x[left].T
        new: list[int] = []
        base = len(self.node)
        for i in range(len(left)):
            best = int(within[i, new].argmax()) if new else 0
            if new and within[i, new[best]] >= copy:
                self.of[block[left[i]]] = base + best
            else:
                self.of[block[left[i]]] = base + len(new)
                new.append(i)
        if not new:
            return
        fresh = np.array(new)
        nodes = base + np.arange(len(fresh))
        self.node = np.concatenate([self.node, block[left[fresh]]])
        self.v = self.x[self.node]
        # Levels fall off geometrically by the node's number, the same on every run.
        draw = ((nodes * 2654435761 + 40503) % (1 << 32) + 0.5) / (1 << 32)
        level = np.minimum((-np.log(draw) / np.log(self.links)).astype(int), len(self.near) - 1)
        self.level = np.concatenate([self.level, level])
        for i, near in enumerate(self.near):
            self.near[i] = np.concatenate([near, np.full((len(fresh), near.shape[1]), -1, "int32")])
        # Candidates: what the walk has found, and the other new nodes of the block.
        cand = np.concatenate([found[left[fresh]], np.broadcast_to(nodes, (len(fresh), len(fresh)))], 1)
        score = np.concatenate([cos[left[fresh]], np.where(np.eye(len(fresh), dtype=bool), -2.0, within[np.ix_(fresh, fresh)])], 1)
        for layer in range(int(level.max()) + 1):
            here = level >= layer
            if layer:
                fits = (cand >= 0) & (self.level[np.maximum(cand, 0)] >= layer)
                if self.top >= layer and base:
                    upper, upper_cos = self._greedy(x[left[fresh[here]]], layer)
                    cand_l, score_l = np.concatenate([cand[here], upper[:, None]], 1), np.concatenate([np.where(fits, score, -2.0)[here], upper_cos[:, None]], 1)
                else:
                    cand_l, score_l = cand[here], np.where(fits, score, -2.0)[here]
            else:
                cand_l, score_l = cand, score
            self._link(nodes[here], cand_l, score_l, layer)
        if self.entry < 0 or level.max() > self.top:
            self.entry, self.top = int(nodes[np.argmax(level)]), int(level.max())

    def _spread(self, cand, score, k: int):
        """The k candidates of each row that are nearer to it than to any chosen before; then the nearest of the others."""
        import numpy as np

        order = np.argsort(-score, 1, kind="stable")[:, : 3 * k]
        cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
        valid = (cand >= 0) & (score > -2)
        v = self.v[np.maximum(cand, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(cand.shape, bool)
        for j in range(cand.shape[1]):
            blocked = (chosen[:, :j] & (between[:, j, :j] > score[:, j, None])).any(1)
            chosen[:, j] = valid[:, j] & ~blocked & (chosen[:, :j].sum(1) < k)
        rank = np.where(chosen, 0, np.where(valid, 1, 2))
        pick = np.argsort(rank, 1, kind="stable")[:, :k]
        return np.where(np.take_along_axis(rank, pick, 1) < 2, np.take_along_axis(cand, pick, 1), -1)

    def _link(self, nodes, cand, score, layer: int) -> None:
        import numpy as np

        near, k = self.near[layer], self.near[layer].shape[1]
        out = self._spread(cand, score, self.links)
        near[nodes, : out.shape[1]] = out
        # The way back: a node with too many neighbours chooses anew.
        a, b = np.repeat(nodes, out.shape[1]), out.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        targets, first = np.unique(b, return_index=True)
        most = int(np.diff(first, append=len(b)).max()) if len(b) else 0
        if not most:
            return
        fan = np.full((len(targets), most), -1, "int64")
        row = np.searchsorted(targets, b)
        fan[row, np.arange(len(b)) - first[row]] = a
        fan = np.where((fan[:, :, None] == near[targets][:, None, :]).any(2), -1, fan)
        both = np.concatenate([near[targets], fan], 1)
        free = (both >= 0).sum(1) <= k
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :k]
        near[targets[free]] = packed[free]
        full = np.nonzero(~free)[0]
        for at in range(0, len(full), STEP):
            f = full[at : at + STEP]
            c = both[f]
            s = np.where(c >= 0, (self.v[np.maximum(c, 0)] @ self.v[targets[f]][:, :, None])[:, :, 0], -2.0)
            near[targets[f]] = self._spread(c, s, k)

    def _greedy(self, q, down_to: int):
        """The nearest node found for each query on layer down_to, coming from the top."""
        import numpy as np

        at = np.full(len(q), self.entry)
        cos = q @ self.v[self.entry]
        for layer in range(self.top, down_to - 1, -1):
            live = np.arange(len(q))
            while len(live):
                c = self.near[layer][at[live]]
                s = np.where(c >= 0, (self.v[np.maximum(c, 0)] @ q[live][:, :, None])[:, :, 0], -2.0)
                best = s.argmax(1)
                better = s[np.arange(len(live)), best] > cos[live]
                live, c, s, best = live[better], c[better], s[better], best[better]
                at[live], cos[live] = c[np.arange(len(live)), best], s[np.arange(len(live)), best]
        return at, cos

    def walk(self, q, width: int):
        """Beams of up to width nodes for each query: their numbers and cosines, falling, and how many nodes were met."""
        import numpy as np

        n, rows = len(self.node), np.arange(len(q))[:, None]
        width = min(width, n)
        start, cos0 = self._greedy(q, 1) if self.top else (np.full(len(q), self.entry), q @ self.v[self.entry])
        beam, cos, done = np.full((len(q), width), -1), np.full((len(q), width), -2.0), np.ones((len(q), width), bool)
        beam[:, 0], cos[:, 0], done[:, 0] = start, cos0, False
        met = np.zeros((len(q), n), bool)
        met[rows[:, 0], start] = True
        live = np.arange(len(q))
        ahead = max(1, min(4, width // 8))
        while len(live):
            # The best nodes of each beam that were not expanded yet.
            s = np.where(done[live], -3.0, cos[live])
            pick = np.argpartition(-s, ahead - 1, 1)[:, :ahead] if ahead < width else np.argsort(-s, 1)[:, :ahead]
            open_ = np.take_along_axis(s, pick, 1) > -2
            some = open_.any(1)
            live, pick, open_ = live[some], pick[some], open_[some]
            if not len(live):
                break
            np.put_along_axis(d := done[live], pick, True, 1)
            c = self.near[0][np.where(open_, np.take_along_axis(beam[live], pick, 1), 0)]
            c = np.where(open_[:, :, None], c, -1).reshape(len(live), -1)
            c = np.where(met[live[:, None], np.maximum(c, 0)], -1, c)
            if ahead > 1:  # two of the expanded nodes may have a neighbour in common
                c = np.sort(c, 1)
                c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            i, j = np.nonzero(c >= 0)
            met[live[i], c[i, j]] = True
            s = np.full(c.shape, -2.0)
            s[i, j] = np.einsum("nd,nd->n", q[live[i]], self.v[c[i, j]])
            all_c, all_s = np.concatenate([beam[live], c], 1), np.concatenate([cos[live], s], 1)
            all_d = np.concatenate([d, c < 0], 1)
            order = np.argpartition(-all_s, width - 1, 1)[:, :width]
            beam[live], cos[live], done[live] = (np.take_along_axis(z, order, 1) for z in (all_c, all_s, all_d))
        order = np.argsort(-cos, 1, kind="stable")
        return np.take_along_axis(beam, order, 1), np.take_along_axis(cos, order, 1), met.sum(1)


def _reached(graph: Graph, q, width: int, threshold: float):
    """Queries and nodes, as two lists: every node a beam has found whose members may reach the threshold. Full beams are widened."""
    import numpy as np

    far = np.arccos(threshold) + graph.radius + _PAD
    bound = np.where(far < np.pi, np.cos(np.minimum(far, np.pi)), -1.0)  # a node counts from this cosine on
    least = bound.min()
    todo, out_q, out_n = np.arange(len(q)), [], []
    while len(todo):
        again = []
        for at in range(0, len(todo), STEP):
            rows = todo[at : at + STEP]
            beam, cos, _ = graph.walk(q[rows], width)
            full = (cos[:, -1] >= least) & (beam.shape[1] < len(graph.node))
            again.append(rows[full])
            i, j = np.nonzero((beam >= 0) & (cos >= bound[np.maximum(beam, 0)]) & ~full[:, None])
            out_q.append(rows[i])
            out_n.append(beam[i, j])
        todo, width = np.concatenate(again), 2 * width
    return np.concatenate(out_q), np.concatenate(out_n)


def _verified(graph: Graph, q, reached, threshold: float):
    """Queries and lists of vectors, in pieces of bounded size: all cosines of at least the threshold, node by node."""
    import numpy as np

    at_q, at_n = reached
    order = np.argsort(at_n, kind="stable")
    at_q, at_n = at_q[order], at_n[order]
    nodes, first = np.unique(at_n, return_index=True)
    for node, lo, hi in zip(nodes.tolist(), first.tolist(), [*first[1:].tolist(), len(at_n)], strict=True):
        members = graph.members[graph.first[node] : graph.first[node + 1]]
        step = max(1, 4_000_000 // len(members))
        for k in range(lo, hi, step):
            queries = at_q[k : min(k + step, hi)]
            i, j = np.nonzero(q[queries] @ graph.x[members].T >= threshold)
            yield queries[i], members[j]


def search(graph: Graph, q, threshold: float, width: int = WIDTH, recall: float = RECALL, audited: int = AUDITED):
    """The nodes to verify for each query, as two lists, with the width and the recall on audited queries that the search ended with."""
    import numpy as np

    while True:
        reached = _reached(graph, q, width, threshold)
        if width >= len(graph.node):
            return reached, width, 1.0
        hit = np.unique(reached[0])
        spread = lambda rows, k: rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)] if len(rows) else rows
        audit = np.unique(np.concatenate([spread(hit, audited // 2), spread(np.arange(len(q)), audited // 2)]).astype("int64"))
        mine = np.isin(reached[0], audit)
        found = sum(len(a) for a, _ in _verified(graph, q, (reached[0][mine], reached[1][mine]), threshold))
        there = sum(int((q[audit[k : k + 16]] @ graph.x.T >= threshold).sum()) for k in range(0, len(audit), 16))
        if found >= recall * there:
            return reached, width, found / there if there else 1.0
        width *= 2



def _joined(up, a, b) -> None:
    """Joins the groups of a[i] and b[i] for all i; up leads from each number to the least of its group."""
    import numpy as np

    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up[:] = up[up]


def _unit(v):
    import numpy as np

    x = np.array(v.tolist(), float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _built(options: dict):
    """The graph of one shard: for each vector its node; for those that are nodes also their number and their neighbours by layer."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("row", ignore_index=True)
        graph = Graph(_unit(pdf["v"]), **options)
        of, near = graph.parts()
        number, lists = np.full(len(pdf), -1), [None] * len(pdf)
        number[graph.node] = np.arange(len(graph.node))
        for i, n in zip(graph.node.tolist(), near, strict=True):
            lists[i] = n
        return pdf.assign(of=of, node=number, near=pd.Series(lists, dtype=object), entry=number == graph.entry)

    return run


def _asked(threshold: float, options: dict):
    """One shard asked by one block, which is the shard itself or another of its label. A row with links: their number, the least row of its group there."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["own", "row"], ascending=[False, True], ignore_index=True)
        n, x, row = int(pdf["own"].sum()), _unit(pdf["v"]), pdf["row"].to_numpy()
        nodes = pdf[pdf["node"] >= 0].sort_values("node")
        graph = Graph.restored(x[:n], pdf["of"].to_numpy("int64")[:n], nodes.index.to_numpy(), nodes["near"].tolist(), int(nodes["node"][nodes["entry"]].iloc[0]))
        same = n == len(pdf)
        asked = x if same else x[n:]
        (at_q, at_n), *_ = search(graph, asked, threshold, **options)
        if same:
            # What one end has found is verified from the other, too: all members of a node with all of the other node.
            k = len(graph.node)
            u = np.concatenate([graph.of[at_q], at_n, np.arange(k)])
            w = np.concatenate([at_n, graph.of[at_q], np.arange(k)])
            u, w = np.divmod(np.unique(u * k + w), k)
            size = np.diff(graph.first)[u]
            at_q = graph.members[np.repeat(graph.first[u] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            at_n = np.repeat(w, size)
        count, up = np.zeros(len(pdf), "int64"), np.arange(len(pdf))
        for a, b in _verified(graph, asked, (at_q, at_n), threshold):
            a = a if same else a + n
            a, b = a[a != b], b[a != b]
            count += np.bincount(a, minlength=len(pdf))
            if not same:
                count += np.bincount(b, minlength=len(pdf))
            _joined(up, a, b)
        linked = np.nonzero(count)[0]
        return pd.DataFrame({"row": row[linked], "links": count[linked], "root": row[up[linked]]})

    return run


def vectors_of(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """row (unique), vec_id, label, v (doubles; null where nothing can be linked with it), size."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(label).isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.when(sound, v).alias("v"), F.size(v).alias("size"))


def build_index(vectors: DataFrame, first_rows: int = FIRST_ROWS, shard_rows: int = SHARD_ROWS, **options) -> DataFrame:
    """A row for each vector: label, size, shard, shards (of the label), row, v, of, node, near, entry. A graph a shard."""
    vectors = vectors.where("v is not null")
    n = vectors.groupBy("label", "size").agg(F.count("*").alias("n"))
    shards = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / first_rows)), F.ceil(F.col("n") / shard_rows))
    n = keep(n.select("label", "size", shards.cast("int").alias("shards")), "shards")
    vectors = vectors.join(sized(n), ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    vectors = vectors.select("label", "size", "shards", "shard", "row", "v")
    schema = vectors.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",of:int,node:int,near:array<array<int>>,entry:boolean"
    return vectors.groupBy("label", "size", "shard").applyInPandas(_built(options), schema)


def near_vectors(df: DataFrame, threshold: float, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", first_rows: int = FIRST_ROWS, shard_rows: int = SHARD_ROWS, graph: dict | None = None, asking: dict | None = None) -> DataFrame:
    """vec_id, n_links (other vectors of the label with a cosine of at least threshold), component_id (least id reachable over links), kept.

    graph and asking are options of Graph and search.
    """
    vectors = keep(vectors_of(df, id_col, vector, label), "vectors")
    index = keep(build_index(vectors, first_rows, shard_rows, **(graph or {})), "index")
    # A pair of shards is asked once, the lower one by the upper one; a link counts for both ends.
    own = index.withColumn("block", F.explode(F.sequence("shard", F.col("shards") - 1))).withColumn("own", F.lit(True))
    blocks = index.where("shard > 0").withColumn("block", F.col("shard")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shard") - 1)))
    blocks = blocks.withColumns({"own": F.lit(False), "of": F.lit(-1), "node": F.lit(-1), "near": F.lit(None).cast("array<array<int>>"), "entry": F.lit(False)})
    cells = own.unionByName(blocks).drop("shards").groupBy("label", "size", "shard", "block")
    found = keep(cells.applyInPandas(_asked(threshold, asking or {}), "row long, links long, root long"), "links")
    groups = connected(found.select(F.col("row").alias("a"), F.col("root").alias("b")), "vector-groups")
    ids = keep(groups.withColumnRenamed("id", "row").join(vectors.select("row", "vec_id"), "row"), "grouped")
    least = ids.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    of = found.groupBy("row").agg(F.sum("links").alias("n_links")).join(ids.join(least, "comp").select("row", "component_id"), "row")
    out = vectors.select("row", "vec_id").join(of, "row", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_graph_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


QUERIES = {"op12_graph_near_dedup": op12_graph_near_dedup}

#: Components of the links are no plain SQL on whole tables; tests hold the query against all pairs.
ORACLE_SQL: dict[str, str] = {}

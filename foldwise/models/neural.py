"""Data-parallel neural models on Spark (M6 MLP regressor, M7 linear layer, M9 input gradient).

Training is synchronous data-parallel gradient descent: every step is one
Spark job in which each partition computes the gradient sums of its own rows
with numpy inside ``mapInPandas``; only per-partition sums (partitions x
parameters numbers) reach the driver, which takes the optimizer step (SGD,
RMSprop or Adam) on the small weight vector.  Batch norm and dropout work
on slices of rows, which a hash of the row key forms, so a fit depends neither on
partitions nor on the size of Arrow batches; running statistics follow the mean
and variance of the whole step.  Prediction is an Arrow-batched ``mapInPandas``
with the weights shipped once per task.

``batch_size = 0`` uses every row per step (one pass per step); batches of a slice's
size or more are steps over the slices of one batch, whose ids are drawn once.

Smaller batches are steps inside the tasks: rows are dealt by a hash of their key into
shards of about ``shard_rows``, each kept as one row of packed arrays; an epoch is one job, in
which a task trains its shards' nets side by side and every shard goes through its rows in an order of its own, batch by batch, from the same weights and optimizer state,
and Spark averages what the shards end with, weighted by their rows.  Up to
``shard_rows`` rows there is one shard, which is plain mini-batch descent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import hash_fraction
from foldwise.session import ship_package


# ---------------------------------------------------------------- numpy kernels (per task)

#: activation by name: value, and derivative from input and value
ACTIVATIONS = {
    "ReLU": (lambda x: np.maximum(x, 0.0), lambda x, a: (x > 0).astype(float)),
    "LeakyReLU": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x, a: np.where(x > 0, 1.0, 0.01)),
    "Tanh": (np.tanh, lambda x, a: 1.0 - a * a),
    "Sigmoid": (lambda x: 1.0 / (1.0 + np.exp(-x)), lambda x, a: a * (1.0 - a)),
}


def _forward(params, x, cfg, train, bn_state=None, rng=None):
    """Forward pass; returns output and the cache needed for the backward pass."""
    cache = []
    h = x
    n_hidden = len(cfg["hidden"])
    for i in range(n_hidden):
        W, b = params[f"W{i}"], params[f"b{i}"]
        z = h @ W + b
        layer = {"h_in": h}
        if cfg["batch_norm"]:
            if train:
                mu, var = z.mean(axis=0), z.var(axis=0)
            else:
                mu, var = bn_state[f"mu{i}"], bn_state[f"var{i}"]
            zhat = (z - mu) / np.sqrt(var + 1e-5)
            layer.update(zhat=zhat, var=var, mu=mu)
            a_in = zhat * params[f"g{i}"] + params[f"be{i}"]
        else:
            a_in = z
        a = ACTIVATIONS[cfg["activation"]][0](a_in)
        layer.update(a_in=a_in, a=a)
        if train and cfg["dropout"] > 0:
            mask = (rng.random(a.shape) >= cfg["dropout"]) / (1.0 - cfg["dropout"])
            a = a * mask
            layer["mask"] = mask
        cache.append(layer)
        h = a
    out = h @ params["Wo"] + params["bo"]
    return out, h, cache


def _backward(params, cfg, cache, h_last, dout):
    grads = {"Wo": h_last.T @ dout, "bo": dout.sum(axis=0)}
    dh = dout @ params["Wo"].T
    for i in reversed(range(len(cfg["hidden"]))):
        layer = cache[i]
        if "mask" in layer:
            dh = dh * layer["mask"]
        da = dh * ACTIVATIONS[cfg["activation"]][1](layer["a_in"], layer["a"])
        if cfg["batch_norm"]:
            zhat, var = layer["zhat"], layer["var"]
            grads[f"g{i}"] = (da * zhat).sum(axis=0)
            grads[f"be{i}"] = da.sum(axis=0)
            dzhat = da * params[f"g{i}"]
            m = dzhat.shape[0]
            inv = 1.0 / np.sqrt(var + 1e-5)
            dz = inv / m * (m * dzhat - dzhat.sum(axis=0) - zhat * (dzhat * zhat).sum(axis=0))
        else:
            dz = da
        grads[f"W{i}"] = layer["h_in"].T @ dz
        grads[f"b{i}"] = dz.sum(axis=0)
        dh = dz @ params[f"W{i}"].T
    return grads


def _reduce_vectors(rows: DataFrame) -> np.ndarray:
    """Element-wise sum of the per-partition vectors in column ``v``, done by
    Spark (partial sums per map task, one row per element after the shuffle);
    only the summed vector reaches the driver."""
    out = (rows.select(F.posexplode("v").alias("i", "x"))
               .groupBy("i").agg(F.sum("x").alias("s")).collect())
    vec = np.zeros(len(out))
    for r in out:
        vec[r.i] = r.s
    return vec


def _flatten(d, names):
    return np.concatenate([np.asarray(d[k], dtype=np.float64).ravel() for k in names])


# ---------------------------------------------------------------- optimizers (driver, small vectors)

class _Optimizer:
    def __init__(self, kind: str, lr: float):
        if kind not in ("SGD", "RMSprop", "Adam"):
            raise ValueError(f"unknown optimizer {kind!r}")
        self.kind, self.lr, self.t = kind, lr, 0
        self.m = self.v = None

    def step(self, params: dict, grads: dict):
        self.t += 1
        if self.m is None:
            self.m = {k: np.zeros_like(v) for k, v in params.items()}
            self.v = {k: np.zeros_like(v) for k, v in params.items()}
        for k in params:
            g = grads[k]
            if self.kind == "SGD":
                params[k] = params[k] - self.lr * g
            elif self.kind == "RMSprop":
                self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
                params[k] = params[k] - self.lr * g / (np.sqrt(self.v[k]) + 1e-8)
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                mh = self.m[k] / (1 - 0.9 ** self.t)
                vh = self.v[k] / (1 - 0.999 ** self.t)
                params[k] = params[k] - self.lr * mh / (np.sqrt(vh) + 1e-8)


# ---------------------------------------------------------------- M6

@dataclass
class MLPConfig:
    input_dim: int
    hidden_dims: list = field(default_factory=lambda: [32, 32])
    output_dim: int = 1
    dropout: float = 0.0
    use_batch_norm: bool = True
    lr: float = 1e-2
    epochs: int = 50
    batch_size: int = 0
    patience: int = 0
    min_delta: float = 0.0
    val_split: float = 0.1
    seed: int = 42
    activation: str = "ReLU"
    slice_rows: int = 1024      # rows, about, that batch norm and dropout see together
    momentum: float = 0.1       # weight of a step in the running statistics
    shard_rows: int = 65_536    # rows, about, that one task takes through batches under a slice's size


def latest_best(losses, min_delta: float = 0.0) -> int:
    """Index of the last loss that undercut all before it by more than ``min_delta``."""
    low = np.minimum.accumulate(np.concatenate([[np.inf], losses]))[:-1]
    kept, best = np.inf, 0
    for i in np.flatnonzero(np.asarray(losses) < low):   # only new minima can count
        if losses[i] < kept - min_delta:
            kept, best = losses[i], int(i)
    return best


def _to_matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 0))


class _LocalNets:
    """Nets of several shards, trained batch by batch in a task, side by side: one array operation
    takes a step of each, so that what a call costs beside its arithmetic is paid once for all.
    Weights, Adam's moments and running statistics of a net are one flat vector, the same for all
    at first; ``params`` are views of the weights, so a step works on them as a whole."""

    def __init__(self, flat: np.ndarray, names, shapes, kcfg, lr: float, momentum: float, nets: int = 1):
        sizes = [int(np.prod(s)) for s in shapes]
        self.n = sum(sizes)
        self.w, self.m, self.v = (np.tile(flat[i * self.n:(i + 1) * self.n], (nets, 1)) for i in range(3))
        self.t, self.bn = np.full(nets, float(flat[3 * self.n])), np.tile(flat[3 * self.n + 1:], (nets, 1))
        self.g = np.empty_like(self.w)
        self.at, self.sizes, self.shapes = np.cumsum([0, *sizes]), sizes, shapes
        self.names, self.kcfg, self.lr, self.momentum = names, kcfg, lr, momentum

    def _views(self, flat: np.ndarray) -> dict:
        """Parameters as (nets, rows, columns); those of one row for all rows of a batch."""
        return {k: flat[:, a:a + z].reshape(len(flat), *(s if len(s) == 2 else (1, *s)))
                for k, a, z, s in zip(self.names, self.at, self.sizes, self.shapes)}

    def params(self, net: int = 0) -> dict:
        return {k: self.w[net, a:a + z].reshape(s) for k, a, z, s in zip(self.names, self.at, self.sizes, self.shapes)}

    def bn_state(self, net: int = 0) -> dict:
        out, at = {}, 0
        for i, h in enumerate(self.kcfg["hidden"] if self.kcfg["batch_norm"] else ()):
            out[f"mu{i}"], out[f"var{i}"] = self.bn[net, at:at + h], self.bn[net, at + h:at + 2 * h]
            at += 2 * h
        return out

    def steps(self, x, y, orders, size: int, rngs) -> np.ndarray:
        """An epoch: net i goes through its rows ``x[i]`` in ``orders[i]``, in batches of ``size``;
        the summed squared error of each net.  As long as all have a whole batch left they go
        together, then each goes on alone."""
        losses = np.zeros(len(x))
        cuts = [batches_of(len(o), size, o) if len(o) else [] for o in orders]
        shared = min(sum(len(b) == size for b in c) for c in cuts) if len(x) > 1 else 0
        if shared:
            # rows of all nets one under the other, each net's in the order of its steps
            order = np.stack([o[:shared * size] for o in orders]) + np.cumsum([0, *[len(r) for r in x[:-1]]])[:, None]
            all_x, all_y, views = np.concatenate(x), np.concatenate(y), (self._views(self.w), self._views(self.g))
            for i in range(0, shared * size, size):
                at = order[:, i:i + size]
                losses += self._step(slice(None), views, all_x[at], all_y[at], rngs)
        for net, c in enumerate(cuts):
            one = slice(net, net + 1)
            views = (self._views(self.w[one]), self._views(self.g[one]))
            for b in c[shared:]:
                losses[net] += self._step(one, views, x[net][b][None], y[net][b][None], rngs[one])[0]
        return losses

    def _step(self, nets: slice, views, x: np.ndarray, y: np.ndarray, rngs) -> np.ndarray:
        """One Adam step of ``nets`` on a batch each (nets, rows, columns); summed squared errors before."""
        (p, grads), kcfg, cache, h, rows = views, self.kcfg, [], x, x.shape[1]
        act, slope = ACTIVATIONS[kcfg["activation"]]
        for i in range(len(kcfg["hidden"])):
            a_in, layer = h @ p[f"W{i}"], {"h_in": h}
            a_in += p[f"b{i}"]
            if kcfg["batch_norm"]:
                mu = np.add.reduce(a_in, axis=1, keepdims=True) / rows
                off = a_in - mu
                var = np.add.reduce(off * off, axis=1, keepdims=True) / rows
                sd = np.sqrt(var + 1e-5)
                off /= sd
                a_in = off * p[f"g{i}"]
                a_in += p[f"be{i}"]
                layer.update(zhat=off, sd=sd, mu=mu, var=var)
            h = act(a_in)
            layer.update(a_in=a_in, a=h)
            if kcfg["dropout"] > 0:
                layer["mask"] = (np.stack([r.random(h.shape[1:]) for r in rngs]) >= kcfg["dropout"]) / (1.0 - kcfg["dropout"])
                h = h * layer["mask"]
            cache.append(layer)
        diff = h @ p["Wo"]
        diff += p["bo"]
        diff -= y
        dout = 2.0 * diff / (rows * y.shape[2])
        np.matmul(h.transpose(0, 2, 1), dout, out=grads["Wo"])
        np.add.reduce(dout, axis=1, keepdims=True, out=grads["bo"])
        dh = dout @ p["Wo"].transpose(0, 2, 1)
        for i in reversed(range(len(cache))):
            layer = cache[i]
            if "mask" in layer:
                dh *= layer["mask"]
            dh *= slope(layer["a_in"], layer["a"])
            if kcfg["batch_norm"]:
                zhat = layer["zhat"]
                np.add.reduce(dh * zhat, axis=1, keepdims=True, out=grads[f"g{i}"])
                np.add.reduce(dh, axis=1, keepdims=True, out=grads[f"be{i}"])
                dh *= p[f"g{i}"]
                total = np.add.reduce(dh, axis=1, keepdims=True)
                along = np.add.reduce(dh * zhat, axis=1, keepdims=True)
                dh *= rows
                dh -= total
                dh -= zhat * along
                dh *= 1.0 / layer["sd"] / rows
            np.matmul(layer["h_in"].transpose(0, 2, 1), dh, out=grads[f"W{i}"])
            np.add.reduce(dh, axis=1, keepdims=True, out=grads[f"b{i}"])
            if i:  # nobody asks for the gradient of the rows themselves
                dh = dh @ p[f"W{i}"].transpose(0, 2, 1)
        self._adam(nets, cache, rows)
        return (diff * diff).sum(axis=(1, 2))

    def _adam(self, nets: slice, cache: list, rows: int) -> None:
        w, m, v, g, bn = self.w[nets], self.m[nets], self.v[nets], self.g[nets], self.bn[nets]
        first = self.t[nets.start or 0] == 0   # nets that go together have taken as many steps
        self.t[nets] += 1
        t = self.t[nets.start or 0]
        move = g - m
        move *= 0.1
        m += move
        g *= g
        g -= v
        g *= 0.001
        v += g
        np.divide(v, 1 - 0.999 ** t, out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(m, 1 - 0.9 ** t, out=move)
        move *= self.lr
        move /= g
        w -= move
        if bn.shape[1]:
            wide = rows / max(1, rows - 1)
            now = np.concatenate([s for c in cache for s in (c["mu"], c["var"] * wide)], axis=2)[:, 0]
            now -= bn
            now *= 1.0 if first else self.momentum
            bn += now

    def flat(self, net: int = 0) -> np.ndarray:
        return np.concatenate([self.w[net], self.m[net], self.v[net], [self.t[net]], self.bn[net]])


def batches_of(n: int, size: int, order: np.ndarray) -> list[np.ndarray]:
    """``order`` cut into batches of ``size``; a single row at the end joins the batch before."""
    cuts = list(range(size, n, size))
    if cuts and n - cuts[-1] == 1:
        cuts.pop()
    return np.split(order, cuts)


#: shards whose nets a task trains side by side; at 65,536 rows of 15 numbers, 8 MB each
SHARDS_TOGETHER = 8


class SparkMLP:
    """M6: linear -> batch norm -> activation -> dropout blocks and a linear output,
    MSE loss, Adam, early stopping with best-weights restore (patience > 0)."""

    def __init__(self, cfg: MLPConfig):
        if cfg.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {cfg.activation!r}")
        self.cfg = cfg
        rng = np.random.default_rng(cfg.seed)
        self.params, prev = {}, cfg.input_dim
        for i, h in enumerate(cfg.hidden_dims):
            lim = 1.0 / np.sqrt(prev)
            self.params[f"W{i}"] = rng.uniform(-lim, lim, (prev, h))
            self.params[f"b{i}"] = rng.uniform(-lim, lim, h)
            if cfg.use_batch_norm:
                self.params[f"g{i}"] = np.ones(h)
                self.params[f"be{i}"] = np.zeros(h)
            prev = h
        lim = 1.0 / np.sqrt(prev)
        self.params["Wo"] = rng.uniform(-lim, lim, (prev, cfg.output_dim))
        self.params["bo"] = rng.uniform(-lim, lim, cfg.output_dim)
        self.bn = {}
        self.names = list(self.params)
        self.history: list = []

    def _kcfg(self):
        return {"hidden": list(self.cfg.hidden_dims), "batch_norm": self.cfg.use_batch_norm,
                "dropout": self.cfg.dropout, "activation": self.cfg.activation}

    def _grad_job(self, df: DataFrame, feats: str, label: str, step: int):
        ship_package(df.sparkSession)
        params, names, kcfg = {k: v.copy() for k, v in self.params.items()}, self.names, self._kcfg()
        n_hidden = len(kcfg["hidden"])
        seed = self.cfg.seed
        n_bn = 2 * sum(kcfg["hidden"]) if kcfg["batch_norm"] else 0
        n_par = sum(v.size for v in params.values())

        def run(pdf):
            # a slice's [n, sse, gradient sums..., n * mean..., n * mean of squares...]
            pdf = pdf.sort_values("_key")
            x = _to_matrix(pdf[feats])
            y = np.asarray(pdf[label].to_list(), dtype=np.float64).reshape(len(pdf), -1)
            rng = np.random.default_rng([seed, step, int(pdf["_slice"].iloc[0])])
            out, h_last, cache = _forward(params, x, kcfg, True, rng=rng)
            diff = out - y
            g = _backward(params, kcfg, cache, h_last, 2.0 * diff / y.shape[1])
            stats = [s for i in range(n_hidden if n_bn else 0)
                     for s in (cache[i]["mu"], cache[i]["var"] + cache[i]["mu"] ** 2)]
            sums = np.concatenate([[len(pdf), float((diff ** 2).sum())], _flatten(g, names),
                                   *(len(pdf) * s for s in stats)])
            return pd.DataFrame({"v": [sums.tolist()]})

        vec = _reduce_vectors(df.groupBy("_slice").applyInPandas(run, "v array<double>"))
        if not len(vec):
            return 0, 0.0, np.zeros(n_par), None
        n = int(vec[0])
        return n, float(vec[1]), vec[2:2 + n_par], vec[2 + n_par:] / n if n_bn else None

    def _unflatten(self, vec):
        out, pos = {}, 0
        for k in self.names:
            size = self.params[k].size
            out[k] = vec[pos:pos + size].reshape(self.params[k].shape)
            pos += size
        return out

    def _set_bn(self, bn):
        """Running mean and variance from a step's mean and mean of squares over all rows."""
        if bn is None:
            return
        pos, first = 0, not self.bn
        for i, h in enumerate(self.cfg.hidden_dims):
            mean, square = bn[pos:pos + h], bn[pos + h:pos + 2 * h]
            for name, now in ((f"mu{i}", mean), (f"var{i}", np.maximum(square - mean ** 2, 0.0))):
                # a step over all rows has their statistics; those of batches are averaged
                w = 1.0 if first or self.cfg.batch_size <= 0 else self.cfg.momentum
                self.bn[name] = now if first else (1.0 - w) * self.bn[name] + w * now
            pos += 2 * h

    def _loss(self, df, feats, label) -> float:
        p = self.predict(df, feats, "_p")
        return p.select(F.avg((F.col("_p")[0] - F.col(label)) ** 2)).first()[0]

    def fit(self, df: DataFrame, feats: str = "features", label: str = "label",
            key: str = "row_id") -> "SparkMLP":
        cfg = self.cfg
        data = df.select(F.col(key).cast("string").alias("_key"),
                         F.col(feats).alias(feats), F.col(label).cast("double").alias(label))
        val = None
        if cfg.patience > 0 and cfg.val_split > 0:
            from foldwise.operators.splits import holdout_split
            split = holdout_split(data.withColumnRenamed("_key", "row_id"), cfg.val_split, 42)
            split = split.withColumnRenamed("row_id", "_key")
            val = split.where("is_val").drop("is_val").persist(StorageLevel.MEMORY_AND_DISK)
            data = split.where("not is_val").drop("is_val")
        if 0 < cfg.batch_size < cfg.slice_rows:
            return self._fit_shards(data, val, feats, label)
        # slices are kept together, so a step doesn't shuffle rows
        n_slices = max(1, data.count() // cfg.slice_rows)
        data = data.withColumn("_slice", F.floor(hash_fraction(cfg.seed * 7919, "_key") * n_slices).cast("long"))
        data = data.repartition("_slice").persist(StorageLevel.MEMORY_AND_DISK)
        n_batches = 1 if cfg.batch_size <= 0 else min(n_slices, max(1, n_slices * cfg.slice_rows // cfg.batch_size))
        opt, losses, states, step = _Optimizer("Adam", cfg.lr), [], {}, 0
        for epoch in range(cfg.epochs):
            seen, sse = 0, 0.0
            for b in range(n_batches):
                rows = data if n_batches == 1 else data.where(F.pmod(F.col("_slice"), F.lit(n_batches)) == b)
                n, loss, g, bn = self._grad_job(rows, feats, label, step)
                step += 1
                if n:
                    opt.step(self.params, self._unflatten(g / n))
                    self._set_bn(bn)
                    seen, sse = seen + n, sse + loss
            train_loss = sse / max(seen, 1)
            losses.append(self._loss(val, feats, label) if val is not None else train_loss)
            self.history.append((epoch + 1, train_loss, losses[-1]))
            best = latest_best(losses, cfg.min_delta)
            if best == epoch:
                states = {epoch: ({k: v.copy() for k, v in self.params.items()}, dict(self.bn))}
            if 0 < cfg.patience <= epoch - best:
                break
        if cfg.patience > 0 and states:
            self.params, self.bn = states[max(states)]
        data.unpersist()
        if val is not None:
            val.unpersist()
        return self

    @staticmethod
    def _packed(rows: DataFrame, feats: str, label: str) -> DataFrame:
        """A row a shard: its rows in the order of their keys as bytes of features, labels and
        whether they are held out.  An epoch reads arrays, not a Python object a row."""
        def pack(pdf):
            pdf = pdf.sort_values("_key", kind="stable")
            y = np.asarray(pdf[label].to_list(), dtype=np.float64)
            return pd.DataFrame({"_slice": pdf["_slice"].iloc[:1].to_numpy(), "_n": [len(pdf)], "_x": [_to_matrix(pdf[feats]).tobytes()],
                                 "_y": [y.tobytes()], "_held": [pdf["_val"].to_numpy(dtype=bool).tobytes()]})

        return rows.groupBy("_slice").applyInPandas(pack, "_slice long, _n long, _x binary, _y binary, _held binary")

    def _shard_job(self, packed: DataFrame, state: np.ndarray, epoch: int, learn: bool):
        """One job: (training loss, loss of the held-out rows under ``state``, state after the epoch)."""
        cfg, kcfg, names = self.cfg, self._kcfg(), self.names
        shapes = [self.params[k].shape for k in names]

        def together(shards):
            # of each shard [rows, their loss, held-out rows, their loss, rows * state...]
            nets, sums = _LocalNets(state, names, shapes, kcfg, cfg.lr, cfg.momentum, len(shards)), np.zeros((len(shards), 4))
            xs, ys, orders, rngs, learning = [], [], [], [], []
            for i, s in enumerate(shards):
                x, y = (np.frombuffer(s[c]).reshape(s["_n"], -1) for c in ("_x", "_y"))
                held = np.frombuffer(s["_held"], dtype=bool)
                if held.any() and nets.t[i]:
                    out = _forward(nets.params(i), x[held], kcfg, False, bn_state=nets.bn_state(i))[0]
                    sums[i, 2:] = held.sum(), float(((out - y[held]) ** 2).sum())
                rngs.append(np.random.default_rng([cfg.seed, epoch, int(s["_slice"])]))
                xs.append(x[~held])
                ys.append(y[~held])
                sums[i, 0] = len(xs[i]) if learn else 0
                orders.append(rngs[i].permutation(int(sums[i, 0])))
            sums[:, 1] = nets.steps(xs, ys, orders, cfg.batch_size, rngs)
            return [np.concatenate([sums[i], sums[i, 0] * nets.flat(i)]).tolist() for i in range(len(shards))]

        def run(it):
            for pdf in it:
                shards = pdf.to_dict("records")
                for at in range(0, len(shards), SHARDS_TOGETHER):
                    yield pd.DataFrame({"v": together(shards[at:at + SHARDS_TOGETHER])})

        vec = _reduce_vectors(packed.mapInPandas(run, "v array<double>"))
        if not len(vec):
            return 0.0, None, state
        n, sse, n_val, sse_val = vec[:4]
        return sse / max(n, 1), sse_val / n_val if n_val else None, vec[4:] / n if n else state

    def _take_state(self, state: np.ndarray) -> None:
        net = _LocalNets(state, self.names, [self.params[k].shape for k in self.names], self._kcfg(), self.cfg.lr, self.cfg.momentum)
        self.params, self.bn = {k: v.copy() for k, v in net.params().items()}, {k: v.copy() for k, v in net.bn_state().items()}

    def _fit_shards(self, data: DataFrame, val: DataFrame | None, feats: str, label: str) -> "SparkMLP":
        """Batches under a slice's size: one job an epoch, which also gives the held-out loss of the
        epoch before (and one more job for that of the last)."""
        cfg = self.cfg
        ship_package(data.sparkSession)
        rows = data.withColumn("_val", F.lit(False))
        n_shards = max(1, round(data.count() / cfg.shard_rows))
        if val is not None:
            rows = rows.unionByName(val.withColumn("_val", F.lit(True)))
        rows = rows.withColumn("_slice", F.floor(hash_fraction(cfg.seed * 7919, "_key") * n_shards).cast("long"))
        # shards of a task take their steps together: neighbours, at most about SHARDS_TOGETHER
        cores = data.sparkSession.sparkContext.defaultParallelism
        tasks = max(min(n_shards, cores), -(-n_shards // SHARDS_TOGETHER))
        rows = self._packed(rows.repartitionByRange(tasks, "_slice"), feats, label).persist(StorageLevel.MEMORY_AND_DISK)
        n = sum(v.size for v in self.params.values())
        n_bn = 2 * sum(cfg.hidden_dims) if cfg.use_batch_norm else 0
        state = np.concatenate([_flatten(self.params, self.names), np.zeros(2 * n + 1 + n_bn)])
        losses, best_state, train_loss = [], state, 0.0
        for epoch in range(cfg.epochs + 1):
            learn = epoch < cfg.epochs
            if not learn and val is None:
                now, held, after = 0.0, None, state
            else:
                now, held, after = self._shard_job(rows, state, epoch, learn)
            if epoch:  # what the epoch before has come to
                losses.append(train_loss if held is None else held)
                self.history.append((epoch, train_loss, losses[-1]))
                best = latest_best(losses, cfg.min_delta)
                if best == epoch - 1:
                    best_state = state
                if 0 < cfg.patience <= epoch - 1 - best:
                    break
            state, train_loss = after, now
        self._take_state(best_state if cfg.patience > 0 and losses else state)
        rows.unpersist()
        if val is not None:
            val.unpersist()
        return self

    def save(self, path: str, spark) -> None:
        """Configuration, weights and running statistics as one row of JSON text."""
        import json
        from dataclasses import asdict
        state = {"cfg": asdict(self.cfg), "params": {k: v.tolist() for k, v in self.params.items()},
                 "bn": {k: v.tolist() for k, v in self.bn.items()}}
        spark.createDataFrame([(json.dumps(state),)], "value string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str, spark) -> "SparkMLP":
        import json
        state = json.loads(spark.read.text(path).first()[0])
        net = cls(MLPConfig(**state["cfg"]))
        net.params = {k: np.array(v) for k, v in state["params"].items()}
        net.bn = {k: np.array(v) for k, v in state["bn"].items()}
        return net

    def predict(self, df: DataFrame, feats: str = "features", out: str = "prediction") -> DataFrame:
        ship_package(df.sparkSession)
        params, bn, kcfg = self.params, dict(self.bn), self._kcfg()

        @F.pandas_udf("array<double>")  # Python sees this column only, not whole rows and their vectors
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(_forward(params, _to_matrix(x), kcfg, False, bn_state=bn)[0]) if len(x) else [], dtype=object)

        return df.withColumn(out, run(F.col(feats).cast("array<double>")))


# ---------------------------------------------------------------- M7 / M9

class LinearLayer:
    """M7: linear layer (+ optional activation) trained by one optimizer step
    per ``fit`` call on the summed loss / n; MSE, L1 or cross-entropy;
    ``input_gradient`` gives d(summed loss)/d(input) per row (M9)."""

    def __init__(self, input_size: int, output_size: int, lr: float = 0.1, loss: str = "mse",
                 optimizer: str = "SGD", activation: str | None = None, bias: bool = True, seed: int = 0,
                 init: str = "uniform"):
        rng = np.random.default_rng(seed)
        lim = 1.0 / np.sqrt(input_size)
        if init == "zeros":
            self.W, self.b = np.zeros((input_size, output_size)), np.zeros(output_size)
        else:
            self.W = rng.uniform(-lim, lim, (input_size, output_size))
            self.b = rng.uniform(-lim, lim, output_size) if bias else np.zeros(output_size)
        self.bias, self.loss, self.activation = bias, loss, activation
        self.opt = _Optimizer(optimizer, lr)
        self.input_size, self.output_size = input_size, output_size

    def save(self, path: str, spark) -> None:
        """Weights, settings and the optimizer's state (see ``store``)."""
        from foldwise.models import store
        store.save(self, path, spark)

    @classmethod
    def load(cls, path: str, spark) -> "LinearLayer":
        from foldwise.models import store
        return store.load(path, spark, cls)

    @staticmethod
    def _act(z, kind):
        if kind is None:
            return z, np.ones_like(z)
        if kind == "Sigmoid":
            s = 1 / (1 + np.exp(-z))
            return s, s * (1 - s)
        if kind == "Tanh":
            t = np.tanh(z)
            return t, 1 - t * t
        if kind == "ReLU":
            return np.maximum(z, 0), (z > 0).astype(float)
        raise ValueError(kind)

    @staticmethod
    def _dloss(out, y, loss):
        if loss == "mse":
            return 2 * (out - y), ((out - y) ** 2).sum()
        if loss == "l1":
            return np.sign(out - y), np.abs(out - y).sum()
        if loss == "ce":  # y = class index in column 0
            m = out.max(axis=1, keepdims=True)
            e = np.exp(out - m)
            p = e / e.sum(axis=1, keepdims=True)
            idx = y[:, 0].astype(int)
            onehot = np.zeros_like(p)
            onehot[np.arange(len(idx)), idx] = 1
            return p - onehot, float(-(np.log(p[np.arange(len(idx)), idx] + 1e-300)).sum())
        raise ValueError(f"unknown loss {loss!r}")

    def _state(self):
        return self.W.copy(), self.b.copy(), self.activation, self.loss

    def fit(self, df: DataFrame, feats: str = "x", label: str = "y") -> "LinearLayer":
        ship_package(df.sparkSession)
        W, b, act, loss = self._state()
        dl = self._dloss

        def run(it):
            gW, gb, n, tot = np.zeros_like(W), np.zeros_like(b), 0, 0.0
            for pdf in it:  # accumulated over the partition: one vector per partition
                if not len(pdf):
                    continue
                x = _to_matrix(pdf[feats])
                y = _to_matrix(pdf[label]) if pdf[label].dtype == object else \
                    pdf[label].to_numpy(dtype=np.float64).reshape(-1, 1)
                z = x @ W + b
                out, dact = LinearLayer._act(z, act)
                g, lsum = dl(out, y, loss)
                if loss != "ce":
                    g = g * dact
                gW += x.T @ g
                gb += g.sum(axis=0)
                n += len(pdf)
                tot += lsum
            yield pd.DataFrame({"v": [[float(n), tot, *gW.ravel().tolist(), *gb.tolist()]]})

        vec = _reduce_vectors(df.select(feats, label).mapInPandas(run, "v array<double>"))
        n = vec[0]
        gW = vec[2:2 + W.size].reshape(W.shape) / n
        gb = vec[2 + W.size:] / n
        p = {"W": self.W, "b": self.b}
        self.opt.step(p, {"W": gW, "b": gb if self.bias else np.zeros_like(gb)})
        self.W, self.b = p["W"], p["b"]
        self.last_loss = vec[1] / n
        return self

    def predict(self, df: DataFrame, feats: str = "x", out: str = "prediction") -> DataFrame:
        ship_package(df.sparkSession)
        W, b, act, _ = self._state()

        @F.pandas_udf("array<double>")  # Python sees this column only
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(LinearLayer._act(_to_matrix(x) @ W + b, act)[0]) if len(x) else [], dtype=object)

        return df.withColumn(out, run(F.col(feats).cast("array<double>")))

    def input_gradient(self, df: DataFrame, feats: str, target: str, out: str = "grad") -> DataFrame:
        """M9: gradient of the summed loss with respect to each row's input."""
        ship_package(df.sparkSession)
        W, b, act, loss = self._state()
        dl = self._dloss

        @F.pandas_udf("array<double>")  # Python sees these two columns only
        def run(features: pd.Series, wanted: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            z = _to_matrix(features) @ W + b
            o, dact = LinearLayer._act(z, act)
            g, _ = dl(o, _to_matrix(wanted), loss)
            if loss != "ce":
                g = g * dact
            return pd.Series(list(g @ W.T))

        return df.withColumn(out, run(F.col(feats).cast("array<double>"), F.col(target).cast("array<double>")))

    def backward_target(self, df: DataFrame, feats: str, target: str, lr: float,
                        out: str = "h_target") -> DataFrame:
        """M9 (BP layer): input - lr * input gradient."""
        g = self.input_gradient(df, feats, target, "_g")
        return g.withColumn(out, F.zip_with(feats, "_g", lambda a, d: a - F.lit(lr) * d)).drop("_g")

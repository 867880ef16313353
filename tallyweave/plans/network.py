"""The arithmetic of the conditional autoencoder on one batch of rows, in numpy.

Runs inside Spark tasks only. The parameters are one flat vector, so that the
copies trained on different partitions can be averaged element by element.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Default settings.
LATENT_SIZE = 16
DEPTH = 2
WIDTH = 32
BETA = 0.1
LEARNING_RATE = 0.001


@dataclass(frozen=True)
class Shape:
    """Columns as (kind, size) and the sizes of the layers.

    The depths count hidden layers; no controls makes the model unconditional.
    """

    features: tuple[tuple[str, int], ...]
    controls: tuple[tuple[str, int], ...] = ()
    latent_size: int = LATENT_SIZE
    width: int = WIDTH
    controls_depth: int = DEPTH
    encoder_depth: int = DEPTH
    decoder_depth: int = DEPTH
    layout: dict = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        shapes = {}

        def embed(name, columns):
            for i, (kind, size) in enumerate(columns):
                # A number has two rows: its slope and its offset.
                shapes[f"{name}{i}"] = (2 if kind == "continuous" else size, self.width)

        def chain(name, inputs, depth):
            for i in range(depth + 1):
                shapes[f"{name}{i}.w"] = (inputs if i == 0 else self.width, self.width)
                shapes[f"{name}{i}.b"] = (self.width,)

        if self.controls:
            embed("y", self.controls)
            chain("label", self.width, self.controls_depth)
        embed("x", self.features)
        chain("enc", self.width, self.encoder_depth)
        for head in ("mu", "var"):
            shapes[head + ".w"] = (self.width, self.latent_size)
            shapes[head + ".b"] = (self.latent_size,)
        chain("dec", self.latent_size, self.decoder_depth)
        for i, (_, size) in enumerate(self.features):
            shapes[f"out{i}.w"] = (self.width, size)
            shapes[f"out{i}.b"] = (size,)
        layout, at = {}, 0
        for name, dims in shapes.items():
            length = int(np.prod(dims))
            layout[name] = (at, at + length, dims)
            at += length
        object.__setattr__(self, "layout", layout)

    @property
    def length(self) -> int:
        return max(stop for _, stop, _ in self.layout.values())

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """Named arrays over the flat vector, without copying."""
        return {n: vector[a:b].reshape(dims) for n, (a, b, dims) in self.layout.items()}


def initial(shape: Shape, seed: int) -> np.ndarray:
    """Embeddings are standard normal, layers uniform within one over the root of their inputs."""
    rng = np.random.default_rng(seed)
    vector = np.empty(shape.length)
    views = shape.views(vector)
    for name, array in views.items():
        is_number = name[1:].isdigit() and (
            (shape.features if name[0] == "x" else shape.controls)[int(name[1:])][0] == "continuous"
        )
        if is_number:
            array[...] = rng.uniform(-1, 1, array.shape)
        elif name[1:].isdigit():
            array[...] = rng.standard_normal(array.shape)
        else:
            inputs = views[name.rsplit(".", 1)[0] + ".w"].shape[0]
            array[...] = rng.uniform(-1, 1, array.shape) / np.sqrt(inputs)
    return vector


def _embed(p, name, columns, data):
    total = 0.0
    for i, (kind, _) in enumerate(columns):
        table = p[f"{name}{i}"]
        if kind == "continuous":
            total = total + data[:, i : i + 1] * table[0] + table[1]
        else:
            total = total + table[data[:, i].astype(np.int64)]
    return total


def _embed_back(g, name, columns, data, grad):
    for i, (kind, _) in enumerate(columns):
        if kind == "continuous":
            g[f"{name}{i}"][0] += data[:, i] @ grad
            g[f"{name}{i}"][1] += grad.sum(axis=0)
        else:
            np.add.at(g[f"{name}{i}"], data[:, i].astype(np.int64), grad)


def _chain(p, name, depth, h):
    """Linear layers with a ReLU between them; returns the inputs of every layer too."""
    inputs = []
    for i in range(depth + 1):
        inputs.append(h)
        h = h @ p[f"{name}{i}.w"] + p[f"{name}{i}.b"]
        if i < depth:
            h = np.maximum(h, 0.0)
    return h, inputs


def _chain_back(p, g, name, depth, inputs, grad):
    for i in range(depth, -1, -1):
        g[f"{name}{i}.w"] += inputs[i].T @ grad
        g[f"{name}{i}.b"] += grad.sum(axis=0)
        grad = grad @ p[f"{name}{i}.w"].T
        if i > 0:
            grad = grad * (inputs[i] > 0)
    return grad


def _labels(shape, p, y):
    if not shape.controls:
        return 0.0, None
    return _chain(p, "label", shape.controls_depth, _embed(p, "y", shape.controls, y))


def encode(shape: Shape, p: dict, x: np.ndarray, y: np.ndarray):
    """Mean and log variance of the latents of each row."""
    h_y, _ = _labels(shape, p, y)
    h, _ = _chain(p, "enc", shape.encoder_depth, _embed(p, "x", shape.features, x) + h_y)
    return h @ p["mu.w"] + p["mu.b"], h @ p["var.w"] + p["var.b"]


def _heads(shape, p, h):
    out = []
    for i, (kind, _) in enumerate(shape.features):
        a = h @ p[f"out{i}.w"] + p[f"out{i}.b"]
        if kind == "continuous":
            out.append(1.0 / (1.0 + np.exp(-a)))
        else:
            e = np.exp(a - a.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
    return out


def decode(shape: Shape, p: dict, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Per feature its probabilities, or its predicted value in a single column."""
    h_y, _ = _labels(shape, p, y)
    h, _ = _chain(p, "dec", shape.decoder_depth, z)
    return _heads(shape, p, h + h_y)


def loss_and_gradient(shape, vector, x, y, eps, beta, weights):
    """Loss of one minibatch and its gradient by the flat parameter vector.

    ``weights`` holds per feature the weight of each token, or None.
    """
    p = shape.views(vector)
    gradient = np.zeros_like(vector)
    g = shape.views(gradient)
    rows, columns = len(x), len(shape.features)

    h_y, label_inputs = _labels(shape, p, y)
    h_e, enc_inputs = _chain(
        p, "enc", shape.encoder_depth, _embed(p, "x", shape.features, x) + h_y
    )
    mu = h_e @ p["mu.w"] + p["mu.b"]
    log_var = h_e @ p["var.w"] + p["var.b"]
    std = np.exp(0.5 * log_var)
    z = mu + std * eps
    h_d, dec_inputs = _chain(p, "dec", shape.decoder_depth, z)
    h = h_d + h_y
    outputs = _heads(shape, p, h)

    recon = 0.0
    grad_h = np.zeros_like(h_d)
    for i, (kind, _) in enumerate(shape.features):
        if kind == "continuous":
            difference = outputs[i][:, 0] - x[:, i]
            recon += np.mean(difference**2)
            slope = outputs[i] * (1.0 - outputs[i])
            grad = 2.0 * difference[:, None] * slope / rows
        else:
            token = x[:, i].astype(np.int64)
            w = np.ones(rows) if weights[i] is None else weights[i][token]
            w = w / w.sum()
            at = np.arange(rows)
            recon -= np.sum(w * np.log(np.maximum(outputs[i][at, token], np.finfo(float).tiny)))
            grad = outputs[i] * w[:, None]
            grad[at, token] -= w
        grad = grad * ((1.0 - beta) / columns)
        g[f"out{i}.w"] += h.T @ grad
        g[f"out{i}.b"] += grad.sum(axis=0)
        grad_h += grad @ p[f"out{i}.w"].T
    kld = np.mean(-0.5 * np.sum(1.0 + log_var - mu**2 - np.exp(log_var), axis=1))

    grad_z = _chain_back(p, g, "dec", shape.decoder_depth, dec_inputs, grad_h)
    grad_mu = grad_z + beta * mu / rows
    grad_var = grad_z * eps * 0.5 * std + beta * 0.5 * (np.exp(log_var) - 1.0) / rows
    for head, grad in (("mu", grad_mu), ("var", grad_var)):
        g[head + ".w"] += h_e.T @ grad
        g[head + ".b"] += grad.sum(axis=0)
    grad_e = grad_mu @ p["mu.w"].T + grad_var @ p["var.w"].T
    grad_in = _chain_back(p, g, "enc", shape.encoder_depth, enc_inputs, grad_e)
    _embed_back(g, "x", shape.features, x, grad_in)
    if shape.controls:
        grad_y = _chain_back(
            p, g, "label", shape.controls_depth, label_inputs, grad_h + grad_in
        )
        _embed_back(g, "y", shape.controls, y, grad_y)
    return (1.0 - beta) * recon / columns + beta * kld, gradient


def adam_step(vector, moment, square, step, gradient, rate, decay=0.01):
    """One step of Adam in place, the weight decay added to the gradient."""
    gradient = gradient + decay * vector
    moment *= 0.9
    moment += 0.1 * gradient
    square *= 0.999
    square += 0.001 * gradient**2
    corrected = np.sqrt(square / (1.0 - 0.999**step)) + 1e-8
    vector -= rate * (moment / (1.0 - 0.9**step)) / corrected

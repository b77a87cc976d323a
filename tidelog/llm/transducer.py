"""Minimal acyclic transducers: sorted terms in, their ordinals out.

`built` adds terms in ascending order and merges equal states as soon as no later term can change them, so the automaton
is minimal when the last term is in, and never larger on the way than the longest term's path beyond that. An arc carries the
number of terms that leave its state by smaller bytes or end there; along a term's path these add up to its place in
the sorted list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """Arcs in ascending order of `keys` (state * 256 + byte); `targets` and `outputs` go with them; `final` marks states.
    State 0 is the start."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    final: np.ndarray

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.outputs, self.final))

    @staticmethod
    def from_bytes(data: bytes) -> Transducer:
        arcs, states = np.frombuffer(data, np.int64, 2)
        cells = [np.frombuffer(data, t, n, at) for t, n, at in (
            (np.int64, arcs, 16), (np.int32, arcs, 16 + 8 * arcs), (np.int32, arcs, 16 + 12 * arcs), (bool, states, 16 + 16 * arcs))]
        return Transducer(*cells)


def built(terms: list[bytes]) -> Transducer:
    """The minimal transducer of distinct terms in ascending order of their bytes. The empty term is allowed."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # finished states: (final, ((byte, state), ...))
    path: list[list] = [[False, []]]  # the last term's states, not finished: [final, [[byte, state], ...]]

    def finish(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            number = register.get(state)
            if number is None:
                number = register[state] = len(states)
                states.append(state)
            byte, _ = path[-1][1][-1]
            path[-1][1][-1] = (byte, number)

    last = b""
    for term in terms:
        common = 0
        while common < min(len(last), len(term)) and last[common] == term[common]:
            common += 1
        finish(common)
        for byte in term[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = term
    finish(0)
    states.append((path[0][0], tuple(path[0][1])))
    # Targets come before their sources, so one pass counts the terms that can be completed from each state.
    counts, outputs = [], []
    for final, arcs in states:
        so_far = int(final)
        out = []
        for _, target in arcs:
            out.append(so_far)
            so_far += counts[target]
        counts.append(so_far)
        outputs.append(out)
    last_state = len(states) - 1  # the start gets number 0, and so on backwards
    keys, targets, values = [], [], []
    for number in range(last_state, -1, -1):
        for (byte, target), value in zip(states[number][1], outputs[number]):
            keys.append((last_state - number) * 256 + byte)
            targets.append(last_state - target)
            values.append(value)
    return Transducer(np.array(keys, np.int64), np.array(targets, np.int32), np.array(values, np.int32),
                      np.array([states[i][0] for i in range(last_state, -1, -1)], bool))


def ordinals(machine: Transducer, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The ordinal of each stretch data[start:stop], -1 where it is no term. All stretches move on by a byte at a time."""
    found = np.full(len(starts), -1, np.int64)
    alive, at = np.arange(len(starts)), starts.astype(np.int64)
    state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    while len(alive):
        ended = at == stops[alive]
        accepted = ended & machine.final[state]
        found[alive[accepted]] = total[accepted]
        alive, at, state, total = alive[~ended], at[~ended], state[~ended], total[~ended]
        if not len(alive) or not len(machine.keys):
            break
        key = state * 256 + data[at]
        arc = np.minimum(np.searchsorted(machine.keys, key), len(machine.keys) - 1)
        go = machine.keys[arc] == key
        arc, alive, at, total = arc[go], alive[go], at[go] + 1, total[go]
        state, total = machine.targets[arc].astype(np.int64), total + machine.outputs[arc]
    return found

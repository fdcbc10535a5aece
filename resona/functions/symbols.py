"""Pitch classes, keys and note strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters of the pitch classes 0..11, counted from A
LETTERS = "ABCDEFGHIJKL"

# fixed values: the octave from A, and the flats' equal sharps
OCTAVE = ["A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#"]
FLATS = {"Ab": "G#", "Gb": "F#", "Eb": "D#", "Db": "C#", "Bb": "A#"}


def letter_code(notes: Column) -> Column:
    """Pitch classes 0..11 as one letter each, so that edit distance counts notes."""
    return F.array_join(
        F.transform(notes, lambda n: F.substring(F.lit(LETTERS), n.cast("int") + 1, F.lit(1))), ""
    )


def key_shift(key: Column) -> Column:
    """Semitones from the key up to A (0 for A itself)."""
    names = OCTAVE + list(FLATS)
    steps = [(12 - i) % 12 for i in range(12)]
    steps += [steps[OCTAVE.index(sharp)] for sharp in FLATS.values()]
    pairs = [F.lit(v) for pair in zip(names, steps) for v in pair]
    return F.element_at(F.create_map(*pairs), F.trim(key))


def transpose_notes(notes: Column, key: Column) -> Column:
    return F.transform(notes, lambda n: F.pmod(n.cast("int") + key_shift(key), F.lit(12)))


def transpose_chroma(rows: Column, key: Column) -> Column:
    """Rotate the twelve pitch rows so that the key's row comes first."""
    shift = key_shift(key)
    return F.concat(F.slice(rows, 13 - shift, shift), F.slice(rows, F.lit(1), 12 - shift))

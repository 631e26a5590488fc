"""Column functions over reads: quality, k-mers, hashing, trimming and the predicates of read QC."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

# The adapter motifs that read QC looks for.
ADAPTERS = (
    "AGATCGGAAGAGC",
    "CTGTCTCTTATACACATCT",
    "GATCGGAAGAGCACACGTCTGAACTCCAGTCA",
    "AATGATACGGCGACCACCGA",
    "CAAGCAGAAGACGGCATACGAGAT",
)


def count_char(seq: Column, char: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(char), F.lit("")))).cast("long")


def phred(qual: Column) -> Column:
    """Phred+33 scores; what lies below '!' wraps to 223..255, characters beyond ASCII are dropped."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c))
    return F.transform(F.filter(codes, lambda c: (c > 0) & (c < 128)), lambda c: F.pmod(c - 33, F.lit(256)))


def reconciled(seq: Column, scores: Column) -> Column:
    """Scores cut to the shorter of sequence and quality."""
    return F.slice(scores, F.lit(1), F.least(F.length(seq), F.size(scores)))


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """Array of the k-mers at 0, step, 2 step, ...; reads shorter than k have none."""
    last = F.greatest(F.length(seq) - k, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(seq, i + 1, F.lit(k)))
    return F.when(F.length(seq) >= k, windows).otherwise(F.array().cast("array<string>"))


def crc_bin(kmer: Column, dim: int) -> Column:
    return (F.crc32(kmer) % dim).cast("int")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def two_bit(kmer: Column) -> Column:
    """The k-mer (A, C, G, T only; k <= 31) as a number in base 4."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def _times(a: Column, c: int) -> Column:
    """a * c modulo 2**64 as a signed bigint, by 16-bit limbs, so that ANSI arithmetic never overflows."""
    x = [F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    y = [(c >> (16 * i)) & 0xFFFF for i in range(4)]
    columns = [sum((x[i] * F.lit(y[j]) for i in range(4) for j in range(4) if i + j == s), F.lit(0).cast("long")) for s in range(4)]
    out, carry = None, F.lit(0).cast("long")
    for s in range(4):
        total = columns[s] + carry
        part = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF)), 16 * s)
        out = part if out is None else out.bitwiseOR(part)
        carry = F.shiftrightunsigned(total, 16)
    return out


# Multipliers of the 64-bit finaliser of MurmurHash3.
FMIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

def with_fmix64(df, source: str, target: str):
    """df with `target` = the 64-bit finaliser of the bigint column `source`; each step is its own column, as
    nested limbs would multiply the expression."""
    shift = lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 33))
    df = df.withColumn("_m0", shift(F.col(source)))
    df = df.withColumn("_m1", _times(F.col("_m0"), FMIX[0])).withColumn("_m2", shift(F.col("_m1")))
    df = df.withColumn("_m3", _times(F.col("_m2"), FMIX[1])).withColumn(target, shift(F.col("_m3")))
    return df.drop("_m0", "_m1", "_m2", "_m3")


def unsigned_mod(x: Column, dim: int) -> Column:
    """x as an unsigned 64-bit number modulo dim (< 2**31)."""
    if dim & (dim - 1) == 0:
        return x.bitwiseAND(F.lit(dim - 1))
    hi, lo = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    return ((hi % dim) * F.lit((1 << 32) % dim) + lo % dim) % dim


_base = np.full(256, 4, dtype=np.uint64)
_base[[ord(c) for c in "ACGT"]] = range(4)


def fmix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of unsigned numbers."""
    with np.errstate(over="ignore"):
        for m in FMIX:
            x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


def kmer_codes(text: bytes, k: int, canonical: bool = False) -> np.ndarray:
    """The runs of k letters A, C, G, T (k <= 31) of an upper-case text as numbers in base 4, in order; canonical:
    the lesser of a run's number and its reverse complement's."""
    base = _base[np.frombuffer(text, dtype=np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    bad = np.concatenate([[0], np.cumsum(base == 4)])
    good = bad[k:] == bad[:-k]
    code = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        code = (code << np.uint64(2)) | (base[j : j + n] & np.uint64(3))
    code = code[good]
    if canonical:
        back = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            back |= (np.uint64(3) - (base[j : j + n] & np.uint64(3))) << np.uint64(2 * j)
        code = np.minimum(code, back[good])
    return code


def hashed_bins(text: bytes, k: int, dim: int, canonical: bool = False) -> np.ndarray:
    """Bins of the k-mers of a text: the finaliser of their codes modulo dim."""
    return fmix64(kmer_codes(text, k, canonical)) % np.uint64(dim)


@lru_cache(8)
def _crc_parts(k: int) -> tuple[int, np.ndarray]:
    """CRC-32 of k zero bytes, and what a byte at each of the k places changes in it: the sum is affine in its bits."""
    zero = zlib.crc32(bytes(k))
    return zero, np.array([[zlib.crc32(bytes(j) + bytes([b]) + bytes(k - 1 - j)) ^ zero for b in range(256)] for j in range(k)], dtype=np.uint32)


def crc_bins(texts: list[bytes], k: int, dim: int, step: int = 1, without: bytes | None = None) -> np.ndarray:
    """Bins of the k-mers at 0, step, 2 step, ... of UTF-8 texts: CRC-32 modulo dim. K-mers that hold the letter
    `without` are left out."""
    other = [t.decode() for t in texts if not t.isascii()]
    texts = [t for t in texts if t.isascii()]
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    n = np.where(size >= k, (size - k) // step + 1, 0)
    at = np.repeat(np.cumsum(size) - size, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if without is not None:
        upto = np.concatenate([[0], np.cumsum(flat == without[0])])
        at = at[upto[at + k] == upto[at]]
    zero, parts = _crc_parts(k)
    crc = np.full(len(at), zero, dtype=np.uint32)
    for j in range(k):
        crc ^= parts[j].take(flat.take(at + j))
    bins = (crc % np.uint32(dim)).astype(np.int64)
    # letters of several bytes: a k-mer has k letters
    words = (t[i : i + k].encode() for t in other for i in range(0, len(t) - k + 1, step))
    more = [zlib.crc32(w) % dim for w in words if without is None or without not in w]
    return np.concatenate([bins, np.array(more, dtype=np.int64)])


def trimmed(seq: Column, five: int = 0, three: int = 0, strict_compat: bool = False) -> Column:
    """seq without its first `five` and last `three` bases. With strict_compat a `three` beyond the length
    counts from the end again, as a negative slice bound does."""
    n = F.length(seq)
    end = n - three
    if strict_compat:
        end = F.when(end < 0, F.greatest(end + n, F.lit(0))).otherwise(end)
    return F.substring(seq, F.lit(five + 1), F.greatest(end - five, F.lit(0)))


def prefix(seq: Column, n: int) -> Column:
    return F.substring(seq, 1, n)


def tail(seq: Column, n: int) -> Column:
    """Last n characters; the whole read where it is shorter or n is 0."""
    return seq if n == 0 else F.substring(seq, F.greatest(F.length(seq) - n + 1, F.lit(1)), F.lit(n))


def poly_g(tail_of_read: Column) -> Column:
    n = F.length(tail_of_read)
    return count_char(F.upper(tail_of_read), "G") >= F.greatest(F.lit(8), F.floor(n * 0.8))

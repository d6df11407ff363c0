"""An adaptive context-mixing range coder for blocks of token ids, as a function that runs in the JVM.

A block is coded from a fresh model, so blocks are independent.

Model of a block.  Order 2 and order 1 predict the id that last followed the
last two ids, or the last one, with a small confidence; how often a prediction
of some confidence comes true is learned.  Order 0 predicts every id that the
block has had by how often it came where the others did not predict it, with the
number of ids counted once (Good-Turing) for ids yet unmet.  The three are mixed: an id's share is the
sum of what each order gives it, and the weights of orders 1 and 2 follow the
likelihood that each gave to the ids so far.

Coder.  A range coder on 40 bits that emits bytes; carries run back into bytes
already emitted.  All arithmetic is on integers, or on doubles by +, -, * and /
alone, so that every machine decodes alike.

Coding is one short step an id after the other, which neither built-in functions
nor NumPy can do at a bearable price.  So the few lines of Java below are
compiled at run time by the compiler that Spark brings along for its own
generated code, and sent to executors as a jar in the shared folder; Spark calls
them as static methods, which take and give text: bytes pass in base 64.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from hashlib import sha256

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_root, open_fs

BLOCK_IDS = 4096

JAVA = r"""
package veriscope;

import java.util.Arrays;
import java.util.Base64;

public final class CLASS {
  // parts of a step, of which orders 1 and 2 have ROOM at most; bits of a table's places
  static final int PARTS = 1 << 16, ROOM = PARTS - 2048, BITS1 = 12, BITS2 = 13, BITS0 = 13;
  static final int MOST = 4096;
  static final long TOP = 1L << 40, LEAST = 1L << 32;
  static final double RATE = 1.0 / 32, HOLD = 0.96, LIFT = 0.02;
  static final double[] START = {0.02, 0.3, 0.6, 0.8};

  // orders 1 and 2: slot + 1 of the predicted id, and two bits of confidence
  final int[] table1 = new int[1 << BITS1], table2 = new int[1 << BITS2];
  final double[] hits1 = new double[4], hits2 = new double[4];
  double weight = 0.5;
  int last = 0, before = 0, place1, place2, said1, said2, share1, share2;

  // order 0: slots by first appearance, counts, and sums of counts as a binary indexed tree
  final int[] index = new int[1 << BITS0], ids = new int[MOST + 1], counts = new int[MOST + 1], tree = new int[MOST + 1];
  int slots = 0, total = 0, once = 0;

  // range coder
  long low, range, code;
  byte[] data;
  int at;

  static final ThreadLocal HELD = new ThreadLocal();

  /** A fresh model; each thread uses its own again. */
  static CLASS fresh(int n) {
    if (n > MOST) throw new IllegalArgumentException(n + " ids in a block of " + MOST);
    CLASS c = (CLASS) HELD.get();
    if (c == null) HELD.set(c = new CLASS());
    Arrays.fill(c.table1, 0);
    Arrays.fill(c.table2, 0);
    Arrays.fill(c.index, 0);
    Arrays.fill(c.counts, 0);
    Arrays.fill(c.tree, 0);
    for (int k = 0; k < 4; k++) c.hits1[k] = c.hits2[k] = START[k];
    c.weight = 0.5;
    c.last = c.before = c.slots = c.total = c.once = c.at = 0;
    c.low = c.code = 0;
    c.range = TOP - 1;
    return c;
  }

  int find(int id) {
    int k = (id * 0x9E3779B1) >>> (32 - BITS0);
    while (index[k] != 0 && ids[index[k] - 1] != id) k = (k + 1) & ((1 << BITS0) - 1);
    return index[k] - 1;
  }

  int add(int id) {
    int k = (id * 0x9E3779B1) >>> (32 - BITS0);
    while (index[k] != 0) k = (k + 1) & ((1 << BITS0) - 1);
    ids[slots] = id;
    index[k] = slots + 1;
    return slots++;
  }

  int below(int slot) {
    int sum = 0;
    for (int k = slot; k > 0; k -= k & -k) sum += tree[k];
    return sum;
  }

  int counted(int slot) {
    return slot < 0 ? 0 : counts[slot];
  }

  /** Shares of PARTS that the ids predicted by orders 1 and 2 have; one that both predict is order 2's. */
  void predict() {
    int near = last * 0x9E3779B1;
    place1 = near >>> (32 - BITS1);
    place2 = (before * 0x85EBCA6B + near) >>> (32 - BITS2);
    int e1 = table1[place1], e2 = table2[place2];
    said1 = (e1 >> 2) - 1;
    said2 = (e2 >> 2) - 1;
    int own1 = said1 < 0 ? 0 : 1 + (int) (weight * hits1[e1 & 3] * ROOM);
    int own2 = said2 < 0 ? 0 : 1 + (int) ((1 - weight) * hits2[e2 & 3] * ROOM);
    long rest = PARTS - own1 - own2, whole = total + once + 1;
    if (said1 >= 0 && said1 == said2) {
      share1 = 0;
      share2 = own1 + own2 + (int) (rest * counts[said2] / whole);
    } else {
      share1 = own1 + (int) (rest * counted(said1) / whole);
      share2 = own2 + (int) (rest * counted(said2) / whole);
    }
  }

  void learn(int slot) {
    int e1 = table1[place1], e2 = table2[place2];
    double like1 = 1 - hits1[0], like2 = 1 - hits2[0];
    if (said1 >= 0) {
      double h = hits1[e1 & 3];
      like1 = said1 == slot ? h : 1 - h;
      hits1[e1 & 3] = h + ((said1 == slot ? 1 : 0) - h) * RATE;
    }
    if (said2 >= 0) {
      double h = hits2[e2 & 3];
      like2 = said2 == slot ? h : 1 - h;
      hits2[e2 & 3] = h + ((said2 == slot ? 1 : 0) - h) * RATE;
    }
    // a hit raises the confidence, a miss lowers it; at the lowest the id is replaced
    table1[place1] = said1 == slot ? (e1 | 3) == e1 ? e1 : e1 + 1 : (e1 & 3) > 0 ? e1 - 1 : (slot + 1) << 2;
    table2[place2] = said2 == slot ? (e2 | 3) == e2 ? e2 : e2 + 1 : (e2 & 3) > 0 ? e2 - 1 : (slot + 1) << 2;
    double a = (weight * HOLD + LIFT) * like1, b = ((1 - weight) * HOLD + LIFT) * like2;
    weight = a / (a + b);
    before = last;
    last = ids[slot] + 1;
    if (slot == said1 || slot == said2) return;
    if (counts[slot] == 0) once++;
    if (counts[slot] == 1) once--;
    counts[slot]++;
    total++;
    for (int k = slot + 1; k < tree.length; k += k & -k) tree[k]++;
  }

  /** Narrow the range to ``width`` from ``from`` on, in units of ``step``. */
  void put(long from, long width, long step) {
    low += step * from;
    range = step * width;
    if (low >= TOP) {
      low -= TOP;
      int k = at - 1;
      data[k]++;
      while (data[k] == 0) {
        k--;
        data[k]++;
      }
    }
    while (range < LEAST) {
      data[at++] = (byte) (low >>> 32);
      low = (low & (LEAST - 1)) << 8;
      range <<= 8;
    }
  }

  int aim(long step, int whole) {
    return (int) Math.min(code / step, whole - 1);
  }

  void take(long from, long width, long step) {
    code -= step * from;
    range = step * width;
    while (range < LEAST) {
      code = (code << 8) | next();
      range <<= 8;
    }
  }

  int next() {
    int k = at++;
    return k < data.length ? data[k] & 255 : 0;
  }

  /** Order 0 without the ids that orders 1 and 2 predict: what stands below a slot. */
  int without(int slot) {
    int sum = below(slot);
    if (said1 >= 0 && said1 < slot) sum -= counts[said1];
    if (said2 >= 0 && said2 != said1 && said2 < slot) sum -= counts[said2];
    return sum;
  }

  int left() {
    return total + once + 1 - counted(said1) - (said2 == said1 ? 0 : counted(said2));
  }

  static byte[] bytes(String text) {
    return (text.indexOf('\r') < 0 ? Base64.getDecoder() : Base64.getMimeDecoder()).decode(text);
  }

  /** Coded bytes of ids of ``width`` little-endian bytes. */
  public static String encode(String text, int width) {
    byte[] in = bytes(text);
    int n = in.length / width;
    CLASS c = fresh(n);
    c.data = new byte[n * (width + 4) + 16];
    for (int i = 0; i < n; i++) {
      int id = 0;
      for (int k = width - 1; k >= 0; k--) id = (id << 8) | (in[i * width + k] & 255);
      c.predict();
      int slot = c.find(id);
      if (slot >= 0 && slot == c.said2) c.put(0, c.share2, c.range >>> 16);
      else if (slot >= 0 && slot == c.said1) c.put(c.share2, c.share1, c.range >>> 16);
      else {
        c.put(c.share1 + c.share2, PARTS - c.share1 - c.share2, c.range >>> 16);
        int left = c.left();
        if (slot >= 0) c.put(c.without(slot), c.counts[slot], c.range / left);
        else {
          c.put(left - c.once - 1, c.once + 1, c.range / left);
          for (int k = width - 2; k >= 0; k -= 2) c.put((id >>> (8 * k)) & 65535, 1, c.range >>> 16);
          slot = c.add(id);
        }
      }
      c.learn(slot);
    }
    // one byte more names a point within the range
    long point = (c.low + LEAST - 1) & ~(LEAST - 1);
    if (point >= TOP) {
      int k = c.at - 1;
      c.data[k]++;
      while (c.data[k] == 0) {
        k--;
        c.data[k]++;
      }
    }
    c.data[c.at++] = (byte) (point >>> 32);
    return Base64.getEncoder().encodeToString(Arrays.copyOf(c.data, c.at));
  }

  /** The ids that encode() coded, ``n`` of them. */
  public static String decode(String text, int n, int width) {
    CLASS c = fresh(n);
    c.data = bytes(text);
    for (int k = 0; k < 5; k++) c.code = (c.code << 8) | c.next();
    byte[] out = new byte[n * width];
    for (int i = 0; i < n; i++) {
      c.predict();
      long step = c.range >>> 16;
      int part = c.aim(step, PARTS);
      int slot;
      if (part < c.share2) {
        slot = c.said2;
        c.take(0, c.share2, step);
      } else if (part < c.share1 + c.share2) {
        slot = c.said1;
        c.take(c.share2, c.share1, step);
      } else {
        c.take(c.share1 + c.share2, PARTS - c.share1 - c.share2, step);
        int left = c.left(), fresh = left - c.once - 1;
        step = c.range / left;
        int v = c.aim(step, left);
        if (v >= fresh) {
          c.take(fresh, c.once + 1, step);
          int id = 0;
          for (int k = width - 2; k >= 0; k -= 2) {
            step = c.range >>> 16;
            int word = c.aim(step, PARTS);
            c.take(word, 1, step);
            id = (id << 16) | word;
          }
          if (c.find(id) >= 0) return "";
          slot = c.add(id);
        } else {
          int first = Math.min(c.said1, c.said2), second = Math.max(c.said1, c.said2);
          int sum = v;
          if (first >= 0 && first != second && sum >= c.below(first)) sum += c.counts[first];
          if (second >= 0 && sum >= c.below(second)) sum += c.counts[second];
          slot = 0;
          int rest = sum;
          for (int k = Integer.highestOneBit(c.slots); k > 0; k >>= 1) {
            int there = c.tree[slot + k], beyond = (there - 1 - rest) >> 31;  // all ones if the slot lies beyond
            slot += k & beyond;
            rest -= there & beyond;
          }
          if (slot >= c.slots) return "";
          // sum - rest stands below the slot, what was added to v for predicted ids is not order 0's
          c.take(v - rest, c.counts[slot], step);
        }
      }
      if (slot < 0) return "";
      c.learn(slot);
      int id = c.ids[slot];
      for (int k = 0; k < width; k++) out[i * width + k] = (byte) (id >>> (8 * k));
    }
    return Base64.getEncoder().encodeToString(out);
  }
}
"""

_NAME = "Coder" + sha256(JAVA.encode()).hexdigest()[:12]
_READY: set[tuple[str, int]] = set()


def coder_class(spark: SparkSession) -> str:
    """The class of the coder, compiled and known to the session and its executors."""
    sc = spark.sparkContext
    path = f"{checkpoint_root(spark)}/veriscope-{_NAME}.jar"
    fs, base = open_fs(path)
    if not fs.get_file_info(base).is_file:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(JAVA.replace("CLASS", _NAME))
        codes, jar = compiler.getBytecodes(), io.BytesIO()
        with zipfile.ZipFile(jar, "w") as z:
            for name in codes:
                z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
        fs.create_dir(base.rpartition("/")[0], recursive=True)
        part = f"{base}.{uuid.uuid4().hex}"  # whole or not there, whoever else writes it
        with fs.open_output_stream(part, compression=None) as out:
            out.write(jar.getvalue())
        fs.move(part, base)
    session = sc.applicationId, spark._jsparkSession.hashCode()
    if session not in _READY:
        spark.sql(f"ADD JAR '{path}'")
        _READY.add(session)
    return f"veriscope.{_NAME}"


def encoded(spark: SparkSession, ids: Column, width: int) -> Column:
    """Coded bytes of a block: little-endian ids of ``width`` bytes each, 2 or 4, at most ``BLOCK_IDS`` of them; null for null."""
    made = F.reflect(F.lit(coder_class(spark)), F.lit("encode"), F.base64(ids), F.lit(width))
    return F.when(ids.isNotNull(), F.unbase64(made))


def decoded(spark: SparkSession, data: Column, n: Column, width: Column) -> Column:
    """The ids that :func:`encoded` coded, ``n`` of them; damaged bytes give others, or none."""
    made = F.reflect(F.lit(coder_class(spark)), F.lit("decode"), F.base64(data), n.cast("int"), width.cast("int"))
    return F.when(data.isNotNull(), F.unbase64(made))

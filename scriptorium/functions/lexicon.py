"""Synonyms of metrics and spellings of units. Misspellings are no part of it: operators reach them by rule."""

from __future__ import annotations

#: Synonyms of the metric entries.
METRIC_ALIASES = {
    "Exact Match": ["em", "em score"],
    "F1": ["f-1", "f1 score"],
    "Macro F1": ["macro-averaged f1", "f1 (macro)"],
    "Recall@20": ["r@20", "rec@20", "recall at 20"],
    "Recall@100": ["r@100", "rec@100", "recall at 100"],
    "MRR@10": ["mrr at 10", "mean reciprocal rank @10"],
    "nDCG@10": ["ndcg at 10", "normalized dcg@10"],
    "Precision@5": ["p@5", "prec@5", "precision at 5"],
    "Accuracy": ["acc", "accuracy score"],
    "Faithfulness": ["faithfulness score"],
    "Citation Precision": ["citation prec.", "cite precision", "precision of citations"],
    "Query Latency": ["latency (query)", "qry latency", "latency per query"],
    "Training Time": ["train time", "time to train"],
    "Indexing Time": ["index time", "time for indexing"],
    "Peak Memory": ["peak mem", "memory (peak)"],
    "Index Size": ["idx size", "size of index"],
    "Throughput": ["query throughput", "throughput (queries)"],
    "Parameter Count": ["param count", "params", "no. of parameters", "# parameters"],
    "Energy Use": ["energy", "energy usage", "energy used"],
}

#: Quantity -> factor to its target unit -> spellings of the unit. Offsets are zero for these quantities.
UNITS = {
    "score": {
        100.0: ["%", "percent", "pct", "per cent", "points", "point", "pts", "pp"],
        10.0: ["‰", "per mille", "permille", "per mil"],
    },
    "duration": {
        1e-3: ["ns", "nanosecond", "nanoseconds"],
        1.0: ["us", "µs", "μs", "usec", "usecs", "microsecond", "microseconds"],
        1e3: ["ms", "msec", "msecs", "millis", "millisecond", "milliseconds"],
        1e6: ["s", "sec", "secs", "second", "seconds"],
        6e7: ["min", "mins", "minute", "minutes"],
        3.6e9: ["h", "hr", "hrs", "hour", "hours"],
        8.64e10: ["d", "day", "days"],
    },
    "memory": {
        1.0: ["B", "byte", "bytes"],
        1e3: ["KB", "kB", "kb", "kilobyte", "kilobytes"],
        1e6: ["MB", "mb", "megabyte", "megabytes"],
        1e9: ["GB", "gb", "gigabyte", "gigabytes"],
        1e12: ["TB", "tb", "terabyte", "terabytes"],
        1024.0: ["KiB", "kib", "kibibyte", "kibibytes"],
        1048576.0: ["MiB", "mib", "mebibyte", "mebibytes"],
        1073741824.0: ["GiB", "gib", "gibibyte", "gibibytes"],
        1099511627776.0: ["TiB", "tib", "tebibyte", "tebibytes"],
    },
    "rate": {
        1.0: ["queries per hour", "queries/hour", "queries/h", "q/h", "per hour", "per h", "QPH"],
        60.0: ["queries per minute", "queries per min", "queries/minute", "queries/min", "q/min", "per minute", "per min", "QPM"],
        3600.0: ["queries per second", "queries per sec", "queries/second", "queries/sec", "queries/s", "q/s", "per second", "per sec", "per s", "QPS", "qps"],
        3.6e6: ["thousand queries per second", "thousand queries/s", "kQPS", "KQPS", "kqps", "k queries/s"],
    },
    "count": {
        1.0: ["parameters", "params", "weights", "parameter", "weight"],
        1e3: ["K", "k", "thousand", "thousands"],
        1e6: ["M", "million", "millions", "mln"],
        1e9: ["B", "bn", "billion", "billions"],
        1e12: ["T", "trillion", "trillions"],
    },
    "energy": {
        1.0: ["J", "joule", "joules"],
        1e3: ["kJ", "KJ", "kilojoule", "kilojoules"],
        1e6: ["MJ", "megajoule", "megajoules"],
        1e9: ["GJ", "gigajoule", "gigajoules"],
        3600.0: ["Wh", "watt-hour", "watt-hours", "watt hours"],
        3.6e6: ["kWh", "KWh", "kilowatt-hour", "kilowatt-hours", "kilowatt hours"],
        3.6e9: ["MWh", "megawatt-hour", "megawatt-hours"],
    },
}

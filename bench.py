"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma separated name prefixes).
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    # bars
    "w06_pct_change", "w07a_rsi_simple", "w08_atr_wilder", "w12_rolling_percentile", "w14_jump_decay",
    "j04_asof_series", "j13_forward_row_lookup", "j16_pairwise_correlation", "m17_daily_rank_study",
    # posts and texts
    "w01_w03_attention_before_open", "w04_w05_lagged_post_features", "w25_keep_best_duplicate", "w32_mention_growth_history",
    "j06_comments_to_first_key", "f01_symbol_mentions", "f02_unknown_symbols", "j10_alias_substring_join", "a05_tone_daily",
    "m25_lexicon_scores", "u02_merge_feeds_by_period",
    # panel
    "p03_quality_drop_reasons", "p16_fill_train_median", "p17_clip_to_train_sigmas", "j09_clear_of_events", "a11_quartile_returns",
    "a17_target_moments", "m12_integrity_suite", "e1_preopen_panel", "e2_calendar_panel", "e3_daily_signals",
    # statistics
    "m01_spearman_pooled", "m01_spearman_pooled_bucketed", "m02_feature_ic_table", "w18_rolling_30_day_ic", "w20_cusum_series",
    "w22_rolling_win_rate", "w23_equity_statistics", "m03_permutation_test", "m04_bootstrap_summary", "m11_granger_lag1",
    "m10_walk_forward_summary",
    # signals and models
    "f12_signal_rule", "f16_risk_budget_position", "w26_sector_cap", "m18_stump_scores", "m19_family_shares", "m24_logistic_text_label",
    # streams
    "t01_stream_daily_mentions", "t05_stream_cooldown",
]


def main() -> None:
    from pulsegrid.plans import registered
    from pulsegrid.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), "12g")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        t = time.perf_counter()
        registered.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

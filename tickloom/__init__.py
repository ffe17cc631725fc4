"""tickloom: PySpark jobs for trading-strategy research over bars, signals, trades, runs and a leaderboard."""

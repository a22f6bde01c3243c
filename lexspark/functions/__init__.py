"""Column functions and the engines behind them."""

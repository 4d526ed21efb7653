"""Column functions and the text rules behind them."""

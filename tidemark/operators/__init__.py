"""DataFrame to DataFrame operators; all columns are arguments."""

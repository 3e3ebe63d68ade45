"""Column -> Column building blocks; nothing here touches a DataFrame."""

"""DataFrame to DataFrame operators over (series_id, dt, r)."""

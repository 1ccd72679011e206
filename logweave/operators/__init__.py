"""DataFrame to DataFrame operators over messages and sessions."""

"""DataFrame operators over events and labels."""

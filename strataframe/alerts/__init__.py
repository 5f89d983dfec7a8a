"""Alert rules, suppression, lifecycle and effectiveness over batches."""

"""ticktide.sources"""
